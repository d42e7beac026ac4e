"""Joins of spans: overlaps, containment, coverage and gaps over tables (object_id, offset, size).

Spark has no interval join, so spans are cut at the borders of `bucket` bytes and meet in an equi-join on (object, bucket);
an overlap is counted in the bucket where it begins. No pair that doesn't share a bucket is formed."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixed
from . import parse

BUCKET = 4096


def _cut(spans: DataFrame, bucket: int) -> DataFrame:
    last = F.greatest(F.col("offset"), F.col("offset") + F.col("size") - 1)
    return spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor(last / bucket))))


def overlaps(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of spans of an object that share a byte; right's columns but object_id get the prefix r_."""
    other = right.select("object_id", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "object_id"])
    other = other.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("r_offset") / bucket), F.floor(F.greatest(F.col("r_offset"), F.col("r_offset") + F.col("r_size") - 1) / bucket))))
    begin = F.greatest("offset", "r_offset")
    met = _cut(left, bucket).join(other, ["object_id", "_bucket"])
    return met.filter((F.col("offset") < F.col("r_offset") + F.col("r_size")) & (F.col("r_offset") < F.col("offset") + F.col("size")) & (F.floor(begin / bucket) == F.col("_bucket"))).drop("_bucket")


def touched(fields: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The fields that share a byte with any run."""
    some = overlaps(fields.select("object_id", "node_id", "offset", "size"), runs.select("object_id", "offset", "size"), bucket)
    return fields.join(some.select("object_id", "node_id").distinct(), ["object_id", "node_id"], "left_semi")


class Tree:
    """The spans of one object's fields, in preorder, as lists: which field a place belongs to."""

    def __init__(self, ids: list[int], parents: list[int | None], begin: list[int], end: list[int]):
        self.begin, self.end = begin, end
        row = dict(zip(ids, range(len(ids))))
        self.kids: dict[int, list[int]] = {}
        for n, p in enumerate(parents):
            if p in row:
                self.kids.setdefault(row[p], []).append(n)
        self.ends: dict[int, list[int] | None] = {}

    def child(self, node: int, at: int) -> int | None:
        """The first child whose span holds the place: by halving among many in rising, separate spans, else one after the other."""
        of = self.kids.get(node, ())
        if len(of) > 16:
            if node not in self.ends:
                rising = all(self.end[a] <= self.begin[b] for a, b in zip(of, of[1:]))
                self.ends[node] = [self.end[n] for n in of] if rising else None
            if (ends := self.ends[node]) is not None:
                of = of[bisect_right(ends, at) :][:1]
        return next((n for n in of if self.begin[n] <= at < self.end[n]), None)

    def field_at(self, at: int) -> int | None:
        """Within the root's span: down from the root, always into the first child that holds the place. Outside it: the smallest field there, the first of equals."""
        if not self.begin:
            return None
        if self.begin[0] <= at < self.end[0]:
            node = 0
            while (inner := self.child(node, at)) is not None:
                node = inner
            return node
        return min((n for n in range(len(self.begin)) if self.begin[n] <= at < self.end[n]), key=lambda n: self.end[n] - self.begin[n], default=None)


def deepest(points: DataFrame, fields: DataFrame) -> DataFrame:
    """points (object_id, at) with the field that a click there selects (Tree.field_at), of the object's own bytes; places outside all fields are left out.

    fields: a row per field, or the outcomes of a parse, whose lists needn't be taken apart. An object's fields and its points are each
    gathered into a row, and these meet in one join: no pair is formed."""
    at = points.select(F.col("object_id").cast("string").alias("object_id"), F.col("at").cast("bigint").alias("at")).filter("at IS NOT NULL")
    if "fields" in fields.columns:
        own = fields.select("object_id", F.expr("transform(filter(fields, f -> f.space_id = 0), f -> struct(f.node_id AS node_id, f.parent_id AS parent_id, f.offset AS offset, f.offset + f.size AS stop, f.path AS path))").alias("f"))
    else:
        each = fields.filter("space_id = 0").select("object_id", F.struct("node_id", "parent_id", "offset", (F.col("offset") + F.col("size")).alias("stop"), "path").alias("f"))
        own = each.groupBy("object_id").agg(F.sort_array(F.collect_list("f")).alias("f"))
    both = at.groupBy("object_id").agg(F.collect_list("at").alias("at")).join(own, "object_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, places = b.column("at").offsets.to_pylist(), b.column("at").values.to_pylist()
            cuts, flat = b.column("f").offsets.to_pylist(), b.column("f").values
            ids, parents, begin, stop = (flat.field(c).to_pylist() for c in ("node_id", "parent_id", "offset", "stop"))
            rows, found = [], []
            for i in range(b.num_rows):
                lo, hi = cuts[i], cuts[i + 1]
                tree = Tree(ids[lo:hi], parents[lo:hi], begin[lo:hi], stop[lo:hi])
                for j in range(ends[i], ends[i + 1]):
                    if (n := tree.field_at(places[j])) is not None:
                        rows.append((i, places[j]))
                        found.append(lo + n)
            of, where = (pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("object_id").take(of), where, flat.field("node_id").take(at), flat.field("path").take(at)], ["object_id", "at", "node_id", "path"])

    return both.select("object_id", "at", "f").mapInArrow(meet, "object_id string, at bigint, node_id int, path string")


def deepest_of(objects: DataFrame, schema_text: str, *, entry: str | None = None, endian: str | None = None) -> DataFrame:
    """deepest() for objects that carry their places: (object_id, content BINARY, at ARRAY<BIGINT>). Each is parsed where it lies, nothing is gathered or joined, and rows of the same object_id stay apart.

    In a layout of fixed places a field is sought once for each place that occurs in a batch."""
    entry, endian = parse.entry_of(schema_text, entry, endian)
    parse.program(schema_text)  # a bad schema fails here
    names = ["object_id", "at", "node_id", "path"]

    def flat(at: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The places, and of each the row."""
        places, rows = at.flatten(), np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
        there = places.is_valid()
        return places.filter(there).to_numpy(zero_copy_only=False), rows[there.to_numpy(zero_copy_only=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prog = parse.program(schema_text)
        slots = fixed.plan(prog.schema, entry, endian)
        if slots:
            tree = Tree(list(range(len(slots))), [s.parent for s in slots], [s.offset for s in slots], [s.offset + s.size for s in slots])
            paths = pa.array([s.path for s in slots], pa.string())
        for b in batches:
            if slots:
                whole = pc.fill_null(pc.greater_equal(pc.binary_length(b.column(1)), slots[0].size), False)
                held = b.filter(whole)
                places, rows = flat(held.column(2))
                known, of = np.unique(places, return_inverse=True)
                nodes = np.array([-1 if (n := tree.field_at(x)) is None else n for x in known.tolist()], np.int32)[of]
                hit = nodes >= 0
                yield pa.RecordBatch.from_arrays([held.column(0).take(pa.array(rows[hit])), pa.array(places[hit], pa.int64()), pa.array(nodes[hit]), paths.take(pa.array(nodes[hit]))], names)
                b = b.filter(pc.invert(whole))
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = []
                for key, content, at in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    own = [r for r in parse.flat_rows(prog.run(content.as_py() or b"", entry, endian).tree) if r[21] == 0]
                    of_object = Tree([r[0] for r in own], [r[1] for r in own], [r[16] for r in own], [r[16] + r[17] for r in own])
                    found += [(key, x, own[n][0], own[n][4]) for x in at or () if x is not None and (n := of_object.field_at(x)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names)

    return objects.select(F.col("object_id").cast("string").alias("object_id"), "content", F.col("at").cast("array<bigint>").alias("at")).mapInArrow(run, "object_id string, at bigint, node_id int, path string")


def islands(spans: DataFrame) -> DataFrame:
    """object_id, offset, size of the union of the spans, as maximal runs."""
    by = Window.partitionBy("object_id").orderBy("offset", "stop")
    stop = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter("size > 0").select("object_id", "offset", (F.col("offset") + F.col("size")).alias("stop")).withColumn("_new", (stop.isNull() | (F.col("offset") > stop)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(by)).groupBy("object_id", "_island").agg(F.min("offset").alias("offset"), F.max("stop").alias("stop")).select("object_id", "offset", (F.col("stop") - F.col("offset")).alias("size"))


def uncovered(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """object_id, offset, len of what the spans leave of each object (object_id, total)."""
    ends = totals.select("object_id", F.col("total").alias("offset"), F.lit(0).cast("bigint").alias("size"))
    all_ = islands(spans).select("object_id", "offset", "size").unionByName(ends)
    before = F.coalesce(F.max(F.col("offset") + F.col("size")).over(Window.partitionBy("object_id").orderBy("offset", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return all_.withColumn("_before", before).filter("offset > _before").select("object_id", F.col("_before").alias("offset"), (F.col("offset") - F.col("_before")).alias("len"))


def gap_after(points: DataFrame, gaps: DataFrame) -> DataFrame:
    """points (object_id, at) with the first gap that begins after them, or the object's first if there is none."""
    both = gaps.select("object_id", F.col("offset").alias("at"), F.lit(0).alias("is_point"), F.col("offset").alias("gap")).unionByName(points.select(F.col("object_id").cast("string").alias("object_id"), F.col("at").cast("bigint").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("bigint").alias("gap")))
    by = Window.partitionBy("object_id")
    later = F.min("gap").over(by.orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("gap_offset", F.coalesce(later, F.min("gap").over(by))).filter("is_point = 1").select("object_id", "at", "gap_offset")


def largest_gaps(gaps: DataFrame, most: int = 300) -> DataFrame:
    by = Window.partitionBy("object_id").orderBy(F.desc("len"), "offset")
    return gaps.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
