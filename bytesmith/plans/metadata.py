"""The comment header of a schema text: name, entry, endian and description."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYS = {"name": "name", "entry": "entry", "endian": "endian", "desc": "description"}
_LINE = re.compile(r"\s*//\s*@(\w+)\s*(.*?)\s*$")


@dataclass(frozen=True)
class Metadata:
    name: str | None = None
    entry: str | None = None
    endian: str | None = None
    description: str | None = None


def order_name(word: str) -> str | None:
    """'be' or 'le' for the usual ways of writing them."""
    w = word.strip().lower()
    return "be" if w in ("be", "big", "big-endian") else "le" if w in ("le", "little", "little-endian") else None


def _is_header(line: str) -> bool:
    m = _LINE.match(line)
    return bool(m and m[1] in KEYS)


def read_metadata(text: str) -> Metadata:
    found: dict[str, str | None] = {}
    for line in text.splitlines():
        if _is_header(line):
            key, value = _LINE.match(line).groups()
            found[KEYS[key]] = (order_name(value) if key == "endian" else value) or None
    return Metadata(**found)


def header(meta: Metadata) -> str:
    return "".join(f"// @{key} {value}\n" for key, attr in KEYS.items() if (value := getattr(meta, attr)))


def with_metadata(meta: Metadata, text: str) -> str:
    """The text with its header replaced."""
    return header(meta) + "".join(line for line in text.splitlines(keepends=True) if not _is_header(line))
