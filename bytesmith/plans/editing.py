"""Help with writing schema texts: candidate readings of a span, suggested names, fields put into a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import RESERVED, SchemaError, parse_schema, tokenize

#: The numbers offered for each width.
BY_WIDTH = {1: ("u8", "i8", "bool", "char"), 2: ("u16", "i16"), 4: ("u32", "i32", "f32"), 8: ("u64", "i64", "f64")}


def candidates(size: int, *, printable: bool = False, ends_with_nul: bool = False) -> list[str]:
    """Types that read a span of `size` bytes, texts first where they look like one."""
    if size <= 0:
        return []
    out = [f"char[{size}]"] if printable and size > 1 else []
    out += ["cstring"] if ends_with_nul and size > 1 else []
    out += BY_WIDTH.get(size, ())
    out += [f"{kind}[{size // width}]" for width, kind in ((2, "u16"), (4, "u32"), (8, "u64")) if size > width and size % width == 0]
    return [*out, f"bytes[{size}]"]


def candidate_table(spans: DataFrame) -> DataFrame:
    """spans (object_id, offset, size, content) with a row per candidate type: the same rules as expressions."""
    h, size = F.hex(F.expr("substring(content, int(offset + 1), int(size))")), F.col("size")
    printable = h.rlike("^(?:[2-6][0-9A-F]|7[0-9A-E])+$")
    nul = h.rlike("00$") & h.rlike("^(?:(?!00)..)+00$")
    parts = [F.when(printable & (size > 1), F.concat(F.lit("char["), size.cast("string"), F.lit("]"))), F.when(nul & (size > 1), F.lit("cstring"))]
    parts += [F.when(size == width, F.lit(kind)) for width, kinds in BY_WIDTH.items() for kind in kinds]
    parts += [F.when((size > width) & (size % width == 0), F.concat(F.lit(f"{kind}["), (size / width).cast("bigint").cast("string"), F.lit("]"))) for width, kind in ((2, "u16"), (4, "u32"), (8, "u64"))]
    parts.append(F.concat(F.lit("bytes["), size.cast("string"), F.lit("]")))
    return spans.filter("size > 0").select("object_id", "offset", "size", F.posexplode(F.array_compact(F.array(*parts))).alias("ordinal", "type"))


def suggested_name(content: Column, offset: Column, size: Column) -> Column:
    """The span as a lower-case name if it has at most 24 bytes, is all there, and is an identifier but for white space around it; else field_ and its offset in hex."""
    span = F.substring(content, (offset + 1).cast("int"), size.cast("int"))
    text = F.regexp_replace(F.decode(span, "ISO-8859-1"), "^[\\t-\\r \u00a0]+|[\\t-\\r \u00a0]+$", "")
    named = (size > 0) & (size <= 24) & (F.octet_length(span) == size) & text.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(named, F.lower(text)).otherwise(F.concat(F.lit("field_"), F.lower(F.hex(offset.cast("bigint")))))


def insert_fields(text: str, struct: str, fields: list[tuple[str, str]]) -> str:
    """The text with (name, type) lines before the struct's closing brace, names made unique; a struct that isn't there is added.

    A text whose braces don't match is returned as it is."""
    try:
        tokens = tokenize(text)
    except SchemaError:
        return text
    depth = 0
    for t in tokens:
        depth += (t.kind == "{") - (t.kind == "}")
        if depth < 0:
            return text
    if depth:
        return text
    m = re.search(rf"(?m)^[ \t]*struct\s+{re.escape(struct)}\s*\{{", text)
    if not m:
        body = "".join(f"    {n} {k}\n" for n, k in _unique(fields, set()))
        return text + ("" if not text or text.endswith("\n") else "\n") + ("\n" if text.strip() else "") + f"struct {struct} {{\n{body}}}\n"
    opens = m.end()
    close, depth = None, 0
    for t in tokens:
        at = _place(text, t.line, t.column)
        if at >= opens:
            depth += (t.kind == "{") - (t.kind == "}")
            if depth < 0:
                close = at
                break
    try:
        used = {f.name for f in parse_schema(text).types[struct].fields}
    except (SchemaError, KeyError):
        used = set()
    line = text.rfind("\n", 0, close) + 1
    own_line = not text[line:close].strip()
    indent = text[line:close] if own_line else ""
    body = "".join(f"{indent}    {n} {k}\n" for n, k in _unique(fields, used))
    return text[:line] + body + text[line:] if own_line else text[:close].rstrip() + "\n" + body + text[close:]


def _place(text: str, line: int, column: int) -> int:
    at = 0
    for _ in range(line - 1):
        at = text.index("\n", at) + 1
    return at + column - 1


def _unique(fields: list[tuple[str, str]], used: set[str]) -> list[tuple[str, str]]:
    out = []
    for name, kind in fields:
        stem, n = (f"{name}_" if name in RESERVED else name), 2
        new = stem
        while new in used:
            new, n = f"{stem}{n}", n + 1
        used.add(new)
        out.append((new, kind))
    return out


def validate(text: str) -> pd.DataFrame:
    """One row: ok, kind, line, column, structs, enums, bitfields."""
    from . import ast as A

    try:
        s = parse_schema(text)
    except SchemaError as e:
        return pd.DataFrame([{"ok": False, "kind": e.kind, "line": e.line, "column": e.column, "structs": 0, "enums": 0, "bitfields": 0}])
    return pd.DataFrame([{"ok": True, "kind": None, "line": None, "column": None, "structs": len(s.of(A.Struct)), "enums": len(s.of(A.Enum)), "bitfields": len(s.of(A.Bitfield))}])
