"""Parse a column of binary objects by a schema: outcomes, a flat table of fields, text and JSON renderings.

Objects are a DataFrame (object_id STRING, content BINARY). Each is parsed where it lies, in Arrow batches; nothing is shuffled. A
null content is an empty object. Layouts of fixed places are read a batch at a time (plans/fixed.py), all others object by object."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import fixed
from ..plans.interpreter import Node, Outcome, Program, coverage_of, deep, leaf_spans
from ..plans.language import parse_schema
from ..plans.metadata import read_metadata

CHECK = "struct<algo:string,computed:decimal(20,0),stored:decimal(20,0),ok:boolean,over_offset:bigint,over_size:bigint>"
FIELD = (
    "struct<node_id:int,parent_id:int,ordinal:int,depth:int,path:string,pos_path:string,name:string,type_name:string,kind:string,v_u:decimal(20,0),v_i:bigint,"
    f"v_f:double,v_bool:boolean,v_str:string,v_bytes:binary,v_enum:struct<value:bigint,name:string>,offset:bigint,size:bigint,description:string,check:{CHECK},"
    "decoded:boolean,space_id:int,is_leaf:boolean>"
)
FAULT = "struct<message:string,offset:bigint,path:string,kind:string,schema_line:int,decoded:boolean>"
COVERAGE = "struct<total:bigint,covered:bigint,gaps:array<struct<offset:bigint,len:bigint>>,truncated:boolean>"

_DEC = pa.decimal128(20, 0)
_CHECK = pa.struct([("algo", pa.string()), ("computed", _DEC), ("stored", _DEC), ("ok", pa.bool_()), ("over_offset", pa.int64()), ("over_size", pa.int64())])
_FIELD = pa.struct([
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("pos_path", pa.string()), ("name", pa.string()),
    ("type_name", pa.string()), ("kind", pa.string()), ("v_u", _DEC), ("v_i", pa.int64()), ("v_f", pa.float64()), ("v_bool", pa.bool_()), ("v_str", pa.string()), ("v_bytes", pa.binary()),
    ("v_enum", pa.struct([("value", pa.int64()), ("name", pa.string())])), ("offset", pa.int64()), ("size", pa.int64()), ("description", pa.string()), ("check", _CHECK),
    ("decoded", pa.bool_()), ("space_id", pa.int32()), ("is_leaf", pa.bool_()),
])
_FAULT = pa.struct([("message", pa.string()), ("offset", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("schema_line", pa.int32()), ("decoded", pa.bool_())])
_COVERAGE = pa.struct([("total", pa.int64()), ("covered", pa.int64()), ("gaps", pa.list_(pa.struct([("offset", pa.int64()), ("len", pa.int64())]))), ("truncated", pa.bool_())])


class ParseFailed(ValueError):
    """Raised by strict parses."""


@lru_cache(maxsize=64)
def program(schema_text: str) -> Program:
    """Parsed once a process."""
    return Program(parse_schema(schema_text))


def entry_of(schema_text: str, entry: str | None, endian: str | None) -> tuple[str, str]:
    """As given, else as the text's header says, else the first struct and little-endian."""
    meta = read_metadata(schema_text)
    return entry or meta.entry or program(schema_text).schema.first_struct or "", endian or meta.endian or "le"


def flat_rows(root: Node, wanted: frozenset[str] | None = None) -> list[tuple]:
    """Nodes in preorder, as tuples in the order of the field struct; `wanted` keeps only the fields of these paths (indexes as []), but numbers all."""
    out: list[tuple] = []
    stack = [(root, None, 0, 0, root.name, "r", 0)]
    n = 0
    while stack:
        node, parent, ordinal, depth, path, pos, space = stack.pop()
        me, n = n, n + 1
        if wanted is None or (_plain(path) if "[" in path else path) in wanted:
            v, k = node.value, node.kind
            out.append((
                me, parent, ordinal, depth, path, pos, node.name, node.type_name, k, v if k in ("u", "bitfield") else None, v if k == "i" else None, v if k == "f" else None, v if k == "bool" else None,
                v if k in ("str", "char") else None, v if k == "bytes" else None, {"value": v[0], "name": v[1]} if k == "enum" else None, node.offset, node.size, node.description, node.check, node.decoded, space, not node.children,
            ))
        if node.children:
            inner = node.space if node.decoded else space
            indexed = node.kind == "array"
            for i in range(len(node.children) - 1, -1, -1):
                c = node.children[i]
                stack.append((c, me, i, depth + 1, f"{path}[{i}]" if indexed else f"{path}.{c.name}", f"{pos}/{i}", inner))
    return out


def flatten(root: Node, wanted: frozenset[str] | None = None) -> list[dict]:
    """flat_rows() by name."""
    names = [f.name for f in _FIELD]
    return [dict(zip(names, row)) for row in flat_rows(root, wanted)]


def _field_lists(rows: list[list[tuple]]) -> pa.Array:
    """Lists of field structs, built a column at a time."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = list(zip(*(x for r in rows for x in r))) or [()] * len(_FIELD)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _FIELD)], fields=list(_FIELD)))


def _plain(path: str) -> str:
    """The path with its indexes left out: Root.items[].key."""
    parts = path.split("[")
    return parts[0] + "".join("[]" + p.split("]", 1)[1] for p in parts[1:])


def value_json(node: Node) -> dict:
    v = node.value
    if node.kind == "bytes":
        v = list(v)
    elif node.kind == "enum":
        v = {"value": v[0], "name": v[1]}
    return {"kind": node.kind} if node.kind in ("struct", "array") else {"kind": node.kind, "value": v}


def tree_json(node: Node) -> dict:
    out = {"name": node.name, "type_name": node.type_name, "value": value_json(node), "offset": node.offset, "size": node.size, "description": node.description}
    if node.check:
        out["check"] = node.check
    if node.decoded:
        out["decoded"] = True
    return out | {"children": [tree_json(c) for c in node.children]}


def outcome_json(o: Outcome) -> str:
    with deep():
        out = {"tree": tree_json(o.tree)}
        if o.fault:
            out["fault"] = {k: v for k, v in vars(o.fault).items() if v is not None}
        return json.dumps(out | {"coverage": coverage_of(leaf_spans(o.tree), o.total)}, ensure_ascii=False)


def shown_value(node: Node) -> str:
    v = node.value
    if node.kind == "bytes":
        return v[:16].hex(" ").upper() + (f" … ({len(v)} bytes)" if len(v) > 16 else "")
    if node.kind in ("str", "char"):
        return json.dumps(v, ensure_ascii=False)
    if node.kind == "enum":
        return f"{v[1]} ({v[0]})" if v[1] is not None else str(v[0])
    if node.kind in ("struct", "array"):
        return f"{{{len(node.children)}}}" if node.kind == "struct" else f"[{len(node.children)}]"
    return str(v).lower() if node.kind == "bool" else f"{v:#x}" if node.kind == "bitfield" else str(v)


def tree_text(root: Node) -> str:
    """name: type = value  [@offset +size]  [check]  // description, a line per node."""
    lines, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        line = f"{'  ' * depth}{node.name}: {node.type_name} = {shown_value(node)}  [@{node.offset} +{node.size}]"
        if node.check:
            line += f"  [{node.check['algo']} {'ok' if node.check['ok'] else 'MISMATCH'}]"
        if node.description:
            line += f"  // {node.description}"
        lines.append(line)
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return "\n".join(lines)


def parse(objects: DataFrame, schema_text: str, *, entry: str | None = None, endian: str | None = None, mode: str = "PERMISSIVE", paths: Iterable[str] | None = None, render: bool = False, covered: bool = True) -> DataFrame:
    """object_id, fields, fault, coverage, failed_checks (and json, tree if `render`): a row per object.

    mode: PERMISSIVE keeps what was read before the first fault; FAILFAST raises. paths: the only fields wanted, such as
    Root.items[].key. Only those leave the Python worker. covered: whether coverage is wanted; it is null if not."""
    entry, endian = entry_of(schema_text, entry, endian)
    program(schema_text)  # a bad schema fails here
    wanted = None if paths is None else frozenset(paths)

    def fast(b: pa.RecordBatch, slots: list[fixed.Slot], some: list[int]) -> pa.RecordBatch:
        """Objects that hold a layout of fixed places whole."""
        stride, sizes = slots[0].size, pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        reader = fixed.Reader(slots, fixed.matrix(b.column(1), stride))
        gaps = pa.StructArray.from_arrays([pa.array(np.full(int((sizes > stride).sum()), stride, np.int64)), pa.array(sizes[sizes > stride] - stride)], names=["offset", "len"])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes > stride)]), pa.int32())
        parts = [pa.array(sizes), pa.array(np.full(len(sizes), stride, np.int64)), pa.ListArray.from_arrays(ends, gaps), pa.array(np.zeros(len(sizes), bool))]
        seen = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(parts, _COVERAGE)], fields=list(_COVERAGE)) if covered else pa.nulls(len(sizes), _COVERAGE)
        return pa.RecordBatch.from_arrays([b.column(0), reader.lists(some, _FIELD), pa.nulls(len(sizes), _FAULT), seen, pa.array(reader.failed())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prog = program(schema_text)
        slots = None if render else fixed.plan(prog.schema, entry, endian)
        some = [n for n, s in enumerate(slots or ()) if wanted is None or _plain(s.path) in wanted]
        for b in batches:
            if slots:
                whole = pc.fill_null(pc.greater_equal(pc.binary_length(b.column(1)), slots[0].size), False)
                held = b.filter(whole)
                for lo in range(0, held.num_rows, 4096):
                    yield fast(held.slice(lo, 4096), slots, some)
                b = b.filter(pc.invert(whole))
            for lo in range(0, b.num_rows, 512):
                ids = b.column(0).slice(lo, 512)
                flat, rest = [], []
                for key, content in zip(ids.to_pylist(), b.column(1).slice(lo, 512)):
                    o = prog.run(content.as_py() or b"", entry, endian)
                    if o.fault and mode == "FAILFAST":
                        raise ParseFailed(f"{key}: {o.fault.kind} at {o.fault.path}, offset {o.fault.offset}: {o.fault.message}")
                    flat.append(flat_rows(o.tree, wanted))
                    row = (vars(o.fault) if o.fault else None, coverage_of(leaf_spans(o.tree), o.total) if covered else None, count_failed(o.tree))
                    rest.append(row + ((outcome_json(o), tree_text(o.tree)) if render else ()))
                others = [pa.array(c, f.type) for c, f in zip(zip(*rest), list(schema)[2:])]
                yield pa.RecordBatch.from_arrays([ids, _field_lists(flat), *others], schema=schema)

    extra = [("json", pa.string()), ("tree", pa.string())] if render else []
    schema = pa.schema([("object_id", pa.string()), ("fields", pa.list_(_FIELD)), ("fault", _FAULT), ("coverage", _COVERAGE), ("failed_checks", pa.int64()), *extra])
    ddl = f"object_id string, fields array<{FIELD}>, fault {FAULT}, coverage {COVERAGE}, failed_checks bigint" + (", json string, tree string" if render else "")
    return objects.select(F.col("object_id").cast("string").alias("object_id"), "content").mapInArrow(run, ddl)


def count_failed(root: Node) -> int:
    n, stack = 0, [root]
    while stack:
        node = stack.pop()
        n += bool(node.check and not node.check["ok"])
        stack.extend(node.children)
    return n


def fields(outcomes: DataFrame) -> DataFrame:
    """A row per node: object_id and the members of the field struct."""
    return outcomes.select("object_id", F.explode("fields").alias("f")).select("object_id", "f.*")


def coverage(outcomes: DataFrame) -> DataFrame:
    """object_id, total, covered, fraction (1 for an empty object), n_gaps, truncated."""
    c = F.col("coverage")
    fraction = F.when(c["total"] == 0, F.lit(1.0)).otherwise(c["covered"] / c["total"])
    return outcomes.select("object_id", c["total"].alias("total"), c["covered"].alias("covered"), fraction.alias("fraction"), F.size(c["gaps"]).alias("n_gaps"), c["truncated"].alias("truncated"))


def gaps(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("object_id", F.explode("coverage.gaps").alias("g")).select("object_id", "g.offset", "g.len")
