"""Overlapping searches for a needle in each object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_object


def offsets_of(data: bytes, needle: bytes, limit: int | None = None) -> list[int]:
    """Where the needle begins, overlaps included; none for an empty needle."""
    out, at = [], data.find(needle) if needle else -1
    while at >= 0 and (limit is None or len(out) < limit):
        out.append(at)
        at = data.find(needle, at + 1)
    return out


def find_all(objects: DataFrame, needle: bytes, limit: int | None = None, content: str = "content") -> DataFrame:
    """object_id, offset. Objects without the needle are dropped in the JVM, before any Python."""
    if not needle:
        return objects.select(F.col("object_id").cast("string").alias("object_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    some = objects.filter(F.contains(F.col(content), F.lit(needle)))
    return per_object(some, [content], lambda c: ((o,) for o in offsets_of(c, needle, limit)), "object_id string, offset bigint")


#: Bytes of needles in one automaton, which every task holds; and in all.
SHARD_BYTES, MOST_BYTES = 32 << 20, 1 << 30


def find_many(objects: DataFrame, needles: DataFrame, content: str = "content", *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """object_id, needle_id, offset for each of the needles (needle_id, needle BINARY).

    Needles are measured first: up to `shard_bytes` of them go into one automaton that all tasks hold; more are dealt by their hash into
    shards, each of which meets the objects in a scan of its own. Over MOST_BYTES are refused."""
    some = needles.filter("octet_length(needle) > 0").select(F.col("needle_id").cast("bigint").alias("needle_id"), "needle")
    size = some.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of needles are more than {MOST_BYTES}")
    shards = max(1, -(-size // shard_bytes))
    out = None
    for k in range(shards):
        rows = _find_shard(objects, some.filter(F.pmod(F.xxhash64("needle"), F.lit(shards)) == k), content)
        out = rows if out is None else out.unionByName(rows)
    return out


def _find_shard(objects: DataFrame, needles: DataFrame, content: str) -> DataFrame:
    import ahocorasick

    listed = [(r.needle_id, bytes(r.needle)) for r in needles.collect()]  # about shard_bytes
    words = [(i, n.decode("latin-1")) for i, n in listed if n]

    made: list = []

    def automaton():
        if not made:
            a = ahocorasick.Automaton()
            by_text: dict[str, list] = {}
            for i, w in words:
                by_text.setdefault(w, []).append(i)
            for w, ids in by_text.items():
                a.add_word(w, (ids, len(w)))
            a.make_automaton()
            made.append(a)
        return made[0]

    def make(c):
        if words and c:
            for end, (ids, n) in automaton().iter(c.decode("latin-1")):
                for i in ids:
                    yield i, end - n + 1

    return per_object(objects, [content], make, "object_id string, needle_id bigint, offset bigint")


def before(hits: DataFrame, offset: int) -> DataFrame:
    """object_id, offset of the last hit strictly before an offset."""
    return hits.filter(F.col("offset") < offset).groupBy("object_id").agg(F.max("offset").alias("offset"))


def after(hits: DataFrame, offset: int) -> DataFrame:
    """object_id, offset of the first hit at or after an offset."""
    return hits.filter(F.col("offset") >= offset).groupBy("object_id").agg(F.min("offset").alias("offset"))
