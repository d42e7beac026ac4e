"""Non-destructive edits: a log (object_id, seq, op, offset, bytes) replayed over each object, value encoding and checksum repair.

op is set, undo, redo or clear. A set outside the object is refused and changes nothing; an empty one does nothing; a set
ends what could be redone. Undo brings back the overlay's former bytes, not the object's."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import NeedleError, hex_needle
from ..plans.interpreter import Node
from .common import per_object
from .parse import entry_of, program


class EncodeError(ValueError):
    pass


def _integer(text: str, size: int, signed: bool) -> int:
    body = text.strip()
    negative = body.startswith("-")
    body = body[1:] if negative else body
    try:
        n = int(body[2:], 16) if body[:2].lower() == "0x" else int(body)
    except ValueError:
        raise EncodeError(f"{text!r} is no number") from None
    n = -n if negative else n
    lo, hi = (-(1 << (8 * size - 1)), (1 << (8 * size - 1)) - 1) if signed else (0, (1 << (8 * size)) - 1)
    if not lo <= n <= hi:
        raise EncodeError(f"{n} is not within {lo} and {hi}")
    return n


def encode_value(kind: str, size: int, big: bool, text: str) -> bytes:
    """The bytes of a value typed by hand: exactly `size`, but one for bool and char. Texts and bytes are padded with zeros."""
    kind = {"unsigned": "u", "signed": "i", "float": "f", "string": "str"}.get(kind, kind)
    text = text.strip()
    if kind in ("u", "i"):
        return _integer(text, size, kind == "i").to_bytes(size, "big" if big else "little", signed=kind == "i")
    if kind == "f":
        if size not in (4, 8):
            raise EncodeError(f"no float has {size} bytes")
        try:
            return struct.pack((">" if big else "<") + ("f" if size == 4 else "d"), float(text))
        except (ValueError, OverflowError):
            raise EncodeError(f"{text!r} is no such float") from None
    if kind == "bool":
        if text.lower() not in ("true", "1", "false", "0"):
            raise EncodeError(f"{text!r} is neither true nor false")
        return bytes([text.lower() in ("true", "1")])
    if kind == "char":
        if len(text) != 1 or ord(text) > 255:
            raise EncodeError(f"{text!r} is no character of one byte")
        return bytes([ord(text)])
    if kind == "str":
        data = text.encode()
    elif kind == "bytes":
        try:
            data = hex_needle(text, empty=True, prefix=True)
        except NeedleError as e:
            raise EncodeError(str(e)) from None
    else:
        raise EncodeError(f"there is no kind {kind}")
    if len(data) > size:
        raise EncodeError(f"{len(data)} bytes don't fit {size}")
    return data.ljust(size, b"\0")


class Overlay:
    """Bytes put over an object of fixed length, with undo and redo."""

    def __init__(self, length: int):
        self.length, self.bytes, self.done, self.undone = length, {}, [], []

    def set(self, offset: int, data: bytes) -> bool:
        if offset < 0 or offset + len(data) > self.length:
            return False
        if data:
            self.done.append((offset, data, [self.bytes.get(offset + i) for i in range(len(data))]))
            self.undone.clear()
            self._put(offset, data)
        return True

    def _put(self, offset: int, data: Iterable[int | None]) -> None:
        for i, b in enumerate(data, offset):
            if b is None:
                self.bytes.pop(i, None)
            else:
                self.bytes[i] = b

    def undo(self) -> bool:
        if not self.done:
            return False
        step = self.done.pop()
        self._put(step[0], step[2])
        self.undone.append(step)
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        step = self.undone.pop()
        self._put(step[0], step[1])
        self.done.append(step)
        return True

    def clear(self) -> None:
        self.bytes.clear()
        self.done.clear()
        self.undone.clear()

    def apply(self, data: bytes) -> bytes:
        out = bytearray(data)
        for i, b in self.bytes.items():
            out[i] = b
        return bytes(out)


def replay(objects: DataFrame, log: DataFrame) -> DataFrame:
    """object_id, content (edited), dirty (offsets that are overlaid, ascending), n_done, n_undone, refused: edited objects only.

    An object's log is replayed in order of seq; objects that no log names are dropped before their bytes move."""
    base = objects.select(F.col("object_id").cast("string").alias("object_id"), "content")
    log = log.select(F.col("object_id").cast("string").alias("object_id"), F.struct("seq", "op", "offset", "bytes").alias("e"))
    steps = log.groupBy("object_id").agg(F.sort_array(F.collect_list("e")).alias("steps"))

    def make(content, steps):
        over, refused = Overlay(len(content or b"")), 0
        for s in steps:
            if s["op"] == "set":
                refused += not over.set(s["offset"], s["bytes"] or b"")
            else:
                getattr(over, s["op"])()
        yield over.apply(content or b""), sorted(over.bytes), len(over.done), len(over.undone), refused

    return per_object(base.join(steps, "object_id"), ["content", "steps"], make, "object_id string, content binary, dirty array<bigint>, n_done int, n_undone int, refused int")


def overlay_sets(objects: DataFrame, sets: DataFrame) -> DataFrame:
    """object_id, content with plain sets applied in order of seq, by Spark's overlay(): no Python, for logs without undo.

    sets: (object_id, seq, offset, bytes), all within their objects."""
    steps = sets.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("seq", "offset", "bytes"))).alias("steps"))
    edited = F.aggregate("steps", F.col("content"), lambda c, s: F.overlay(c, s["bytes"], (s["offset"] + 1).cast("int"), F.octet_length(s["bytes"])))
    return objects.join(steps, "object_id").select("object_id", edited.alias("content"))


def last_edit(sets: DataFrame) -> DataFrame:
    """object_id, at, byte: of each overlaid offset the last set wins."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length("bytes") - 1), lambda i: F.struct((F.col("offset") + i).alias("at"), F.conv(F.hex(F.substring(F.col("bytes"), (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int").alias("byte")))
    return sets.filter("octet_length(bytes) > 0").select("object_id", "seq", F.explode(bytes_).alias("x")).groupBy("object_id", "x.at").agg(F.max_by("x.byte", "seq").alias("byte"))


def field_edits(fields: DataFrame, changes: pd.DataFrame | DataFrame, endian: str = "le") -> DataFrame:
    """A log of sets from changes (object_id, path, text): each value is encoded for its field's kind, width and byte order."""
    wanted = changes if isinstance(changes, DataFrame) else fields.sparkSession.createDataFrame(changes)
    named = fields.filter("space_id = 0").join(wanted, ["object_id", "path"])

    def make(kind, type_name, offset, size, text):
        base = "i" if kind == "enum" else "u" if kind == "bitfield" else kind
        yield offset, encode_value(base, size, type_name.endswith("be") or (endian == "be" and not type_name.endswith("le")), text)

    return per_object(named, ["kind", "type_name", "offset", "size", "text"], make, "object_id string, offset bigint, bytes binary")


PASSES = 8


def _bad_checks(root: Node, big: bool) -> Iterable[tuple[int, int, int, bool]]:
    """(offset, size, value, big) of the mismatches among the object's own bytes: decoded ones aren't in it."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.check and not node.check["ok"]:
            yield node.offset, node.size, node.check["computed"], node.type_name.endswith("be") or (big and not node.type_name.endswith("le"))
        if not node.decoded:
            stack.extend(reversed(node.children))


def repair(data: bytes, schema_text: str, entry: str, endian: str) -> tuple[bytes, int, int]:
    """The bytes with right checksums, how many were written, how many still don't match; a sum may cover others, so up to PASSES passes."""
    prog, fixed = program(schema_text), 0
    for _ in range(PASSES):
        todo = [(at, size, v, b) for at, size, v, b in _bad_checks(prog.run(data, entry, endian).tree, endian == "be") if v < 1 << (8 * size)]
        if not todo:
            break
        out = bytearray(data)
        for at, size, v, b in todo:
            out[at : at + size] = v.to_bytes(size, "big" if b else "little")
        data, fixed = bytes(out), fixed + len(todo)
    return data, fixed, len(list(_bad_checks(prog.run(data, entry, endian).tree, endian == "be")))


def fix_checksums(objects: DataFrame, schema_text: str, *, entry: str | None = None, endian: str | None = None) -> DataFrame:
    """object_id, content, fixed, remaining."""
    entry, endian = entry_of(schema_text, entry, endian)
    return per_object(objects, ["content"], lambda c: (repair(c or b"", schema_text, entry, endian),), "object_id string, content binary, fixed int, remaining int")
