"""Byte diffs of pairs of objects, queries over their runs, and field-level diffs of parsed trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixed
from . import parse
from .analysis import _runs
from .common import per_object

MAX_RUNS = 1_000_000


def changed_runs(a: bytes, b: bytes) -> tuple[list[tuple[int, int]], int]:
    """(offset, size) of the maximal runs of different bytes over the common length, and the number of changed bytes there."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return [], 0
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return [(s, e - s) for s, e in _runs(differs)], int(np.count_nonzero(differs))


def diff_runs(pairs: DataFrame, most: int = MAX_RUNS) -> DataFrame:
    """object_id, run, offset, size: from (object_id, left BINARY, right BINARY). Equal pairs end in the JVM."""
    unequal = pairs.filter(~F.coalesce(F.col("left"), F.lit(b"")).eqNullSafe(F.coalesce(F.col("right"), F.lit(b""))))
    return per_object(unequal, ["left", "right"], lambda a, b: ((i, *r) for i, r in enumerate(changed_runs(a or b"", b or b"")[0][:most])), "object_id string, run int, offset bigint, size bigint")


def diff_summary(pairs: DataFrame, most: int = MAX_RUNS) -> DataFrame:
    """object_id, left_size, right_size, changed (exact), runs (exact), truncated."""

    def make(a, b):
        runs, changed = changed_runs(a or b"", b or b"")
        yield len(a or b""), len(b or b""), changed, len(runs), len(runs) > most

    return per_object(pairs, ["left", "right"], make, "object_id string, left_size bigint, right_size bigint, changed bigint, runs bigint, truncated boolean")


def runs_in(runs: DataFrame, offset: int, size: int) -> DataFrame:
    """The runs that overlap a window."""
    return runs.filter((F.col("offset") < offset + size) & (F.col("offset") + F.col("size") > offset))


def next_change(runs: DataFrame, points: DataFrame) -> DataFrame:
    """points (object_id, at) with the offsets of the first run strictly after and the last strictly before: an as-of join.

    Runs and points are merged by object and offset in one sort; no pair is formed."""
    both = runs.select("object_id", F.col("offset").alias("at"), F.lit(0).alias("is_point"), F.col("offset").alias("run")).unionByName(
        points.select(F.col("object_id").cast("string").alias("object_id"), F.col("at").cast("bigint").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("bigint").alias("run"))
    )
    by = Window.partitionBy("object_id").orderBy("at")
    # By value, so that a run at the point itself is on neither side.
    later, earlier = by.rangeBetween(1, Window.unboundedFollowing), by.rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("next", F.min("run").over(later)).withColumn("previous", F.max("run").over(earlier)).filter("is_point = 1").select("object_id", "at", "next", "previous")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """object_id, pos_path, path, status for the fields of left: same, changed or gone, by place in the tree.

    A leaf is changed if its span or value is; a container if its span, its number of children or anything in it is."""
    shown = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("kind", "v_u", "v_i", "v_f", "v_bool", "v_str")], F.coalesce(F.hex("v_bytes"), F.lit("-")), F.coalesce(F.to_json("v_enum"), F.lit("-")))
    cut = lambda df: df.filter("space_id = 0").select("object_id", "pos_path", "path", "is_leaf", F.struct("offset", "size").alias("span"), shown.alias("shown"))
    a, b = cut(left).alias("a"), cut(right).alias("b")
    both = a.join(b, (F.col("a.object_id") == F.col("b.object_id")) & (F.col("a.pos_path") == F.col("b.pos_path")), "full")
    own = F.when(F.col("b.pos_path").isNull(), "gone").when(F.col("a.pos_path").isNull(), "new").when((F.col("a.span") != F.col("b.span")) | (F.col("a.is_leaf") & (F.col("a.shown") != F.col("b.shown"))), "changed").otherwise("same")
    flat = both.select(F.coalesce("a.object_id", "b.object_id").alias("object_id"), F.coalesce("a.pos_path", "b.pos_path").alias("pos_path"), F.col("a.path").alias("path"), own.alias("own"))
    # Each change is told to all containers above it: their number is the depth, which is bounded.
    above = flat.filter("own != 'same'").select("object_id", F.split("pos_path", "/").alias("p")).select("object_id", F.explode(F.expr("transform(sequence(1, greatest(1, size(p) - 1)), i -> array_join(slice(p, 1, i), '/'))")).alias("pos_path")).distinct().withColumn("inside", F.lit(True))
    return flat.filter("own != 'new'").join(above, ["object_id", "pos_path"], "left").select("object_id", "pos_path", "path", F.when((F.col("own") == "same") & F.col("inside"), "changed").otherwise(F.col("own")).alias("status"))


_NODE = pa.struct([("pos_path", pa.string()), ("path", pa.string()), ("status", pa.string())])


def _statuses(left: list[tuple], right: list[tuple]) -> list[tuple[str, str, str]]:
    """tree_diff() of one object: (pos_path, path, status) from the rows of parse.flat_rows()."""
    shown = lambda r: (r[16:18], r[22], (*r[8:11], repr(r[11]), *r[12:16]))
    a, b = ({r[5]: (r[4], *shown(r)) for r in rows if r[21] == 0} for rows in (left, right))
    own, inside = {}, set()
    for pos in a.keys() | b.keys():
        x, y = a.get(pos), b.get(pos)
        own[pos] = "gone" if y is None else "new" if x is None else "changed" if x[1] != y[1] or x[2] and x[3] != y[3] else "same"
        if own[pos] != "same":
            while "/" in pos:
                pos = pos.rpartition("/")[0]
                inside.add(pos)
    return [(pos, x[0], "changed" if own[pos] == "same" and pos in inside else own[pos]) for pos, x in a.items()]


def tree_diff_of(pairs: DataFrame, schema_text: str, *, entry: str | None = None, endian: str | None = None, paths: Iterable[str] | None = None) -> DataFrame:
    """tree_diff() of the two contents of each row (object_id, left BINARY, right BINARY): both are parsed and compared where they lie.

    Nothing is joined or shuffled, and rows of the same object_id stay apart. paths: as for parse()."""
    entry, endian = parse.entry_of(schema_text, entry, endian)
    parse.program(schema_text)  # a bad schema fails here
    wanted = None if paths is None else frozenset(paths)

    def fast(b: pa.RecordBatch, slots: list[fixed.Slot], some: list[int]) -> pa.RecordBatch:
        """Pairs that hold a layout of fixed places whole: no span differs."""
        left, right = (fixed.Reader(slots, fixed.matrix(b.column(c), slots[0].size)) for c in (1, 2))
        changed = np.zeros((len(slots), b.num_rows), bool)
        for n in some:
            if not slots[n].kids and (differs := left.differs(n, right)).any():
                up: int | None = n
                while up is not None:
                    changed[up] |= differs
                    up = slots[up].parent
        same = lambda values: pa.array(values, pa.string()).take(pa.array(np.tile(np.arange(len(some)), b.num_rows)))
        status = pa.array(["same", "changed"]).take(pa.array(changed[some].T.ravel().astype(np.int8)))
        flat = pa.StructArray.from_arrays([same([slots[n].pos for n in some]), same([slots[n].path for n in some]), status], fields=list(_NODE))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(some), pa.int32()), flat)], ["object_id", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prog = parse.program(schema_text)
        slots = fixed.plan(prog.schema, entry, endian)
        some = [n for n, s in enumerate(slots or ()) if wanted is None or parse._plain(s.path) in wanted]
        for b in batches:
            if slots:
                whole = pc.and_(*[pc.fill_null(pc.greater_equal(pc.binary_length(b.column(c)), slots[0].size), False) for c in (1, 2)])
                held = b.filter(whole)
                for lo in range(0, held.num_rows, 4096):
                    yield fast(held.slice(lo, 4096), slots, some)
                b = b.filter(pc.invert(whole))
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = [_statuses(*(parse.flat_rows(prog.run(c.as_py() or b"", entry, endian).tree, wanted) for c in two)) for two in zip(part.column(1), part.column(2))]
                found = pa.array([[dict(zip(("pos_path", "path", "status"), x)) for x in r] for r in rows], pa.list_(_NODE))
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["object_id", "nodes"])

    nodes = pairs.select(F.col("object_id").cast("string").alias("object_id"), "left", "right").mapInArrow(run, "object_id string, nodes array<struct<pos_path:string,path:string,status:string>>")
    return nodes.select("object_id", F.explode("nodes").alias("n")).select("object_id", "n.*")
