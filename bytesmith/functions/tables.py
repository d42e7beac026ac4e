"""The engine as table functions, for LATERAL joins in SQL: parse_fields, find_strings, detect_formats, guess_values, shape_hints.

`register(spark)` makes them known. They run row at a time in Python; the operators on DataFrames are the way for whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.analysis import find_strings, guesses, hints
from ..operators.detect import HEAD, registry
from ..operators.parse import entry_of, flatten, program


@udtf(returnType="node_id int, parent_id int, path string, type_name string, kind string, value string, offset bigint, size bigint")
class ParseFields:
    """parse_fields(content, schema): the fields that were read before the first fault."""

    def eval(self, content: bytes, schema: str) -> Iterator[tuple]:
        entry, endian = entry_of(schema, None, None)
        for r in flatten(program(schema).run(bytes(content or b""), entry, endian).tree):
            shown = next((r[c] for c in ("v_u", "v_i", "v_f", "v_bool", "v_str") if r[c] is not None), None)
            shown = r["v_bytes"].hex() if r["v_bytes"] is not None else r["v_enum"]["value"] if r["v_enum"] else shown
            yield r["node_id"], r["parent_id"], r["path"], r["type_name"], r["kind"], None if shown is None else str(shown).lower() if r["kind"] == "bool" else str(shown), r["offset"], r["size"]


@udtf(returnType="ordinal int, offset bigint, size bigint, encoding string, text string")
class FindStrings:
    """find_strings(content, least)."""

    def eval(self, content: bytes, least: int) -> Iterator[tuple]:
        yield from ((i, *h) for i, h in enumerate(find_strings(bytes(content or b""), least)))


@udtf(returnType="rank int, format string, confidence int, description string")
class DetectFormats:
    """detect_formats(content): the signatures that match, best first."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        head = bytes(content or b"")[:HEAD]
        found = [s for s in registry() if all(head[o : o + len(h) // 2] == bytes.fromhex(h) for o, h in s["parts"])]
        found.sort(key=lambda s: (-s["confidence"], -s["magic_bytes"], s["ordinal"]))
        yield from ((i, s["format"], s["confidence"], s["description"]) for i, s in enumerate(found, 1))


@udtf(returnType="ordinal int, label string, detail string")
class GuessValues:
    """guess_values(content): what the first 16 bytes may be."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from ((i, *g) for i, g in enumerate(guesses(bytes(content or b"")[:16])))


@udtf(returnType="ordinal int, label string, detail string, offset bigint, size bigint")
class ShapeHints:
    """shape_hints(content)."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from ((i, *h) for i, h in enumerate(hints(bytes(content or b""))))


FUNCTIONS = {"parse_fields": ParseFields, "find_strings": FindStrings, "detect_formats": DetectFormats, "guess_values": GuessValues, "shape_hints": ShapeHints}


def register(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, made)
