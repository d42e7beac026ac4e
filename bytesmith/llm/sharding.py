"""Sharding by longest-processing-time scheduling: groups, largest first, go to the least-loaded shard.

Documents with equal texts form a group and stay together; null texts form a group of their own, of no bytes.
A document's size is its text's UTF-8 bytes plus `overhead`. Groups of equal size are interchangeable for the
schedule, so the driver sees only a histogram (size, number of groups), which it reads in descending order, a partition at a time. It keeps
the shards' loads and CHUNK sizes, whose part of the schedule it writes out before it reads on; so what it holds doesn't grow
with the data. For each size the schedule says how many of its groups
each shard takes, just as a heap would one by one; within a size, groups are dealt by their digest. Null ids, repeated rows and ties
are rows of their own; an empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, ranked, staged


#: Distinct sizes of which the driver holds the schedule at a time.
CHUNK = 50_000
PLAN = "group_size long, to array<int>, upto array<long>"


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For (size, count), largest first: (size, the shards that take some, the cumulated counts)."""
    loads = [(0, k) for k in range(shards)]
    for size, count in sizes:
        if count <= 4 * shards:
            took: dict[int, int] = {}
            for _ in range(count):
                load, k = loads[0]
                heapq.heapreplace(loads, (load + size, k))
                took[k] = took.get(k, 0) + 1
        else:  # the count smallest of the progressions load + i * size are what the heap would pop
            base = dict((k, load) for load, k in loads)
            lo, hi = min(base.values()) - 1, max(base.values()) + size * count
            upto = lambda v: {k: max(0, (v - b) // size + 1) if v >= b else 0 for k, b in base.items()}
            while lo < hi:  # the greatest v with at most count pops
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if sum(upto(mid).values()) <= count else (lo, mid - 1)
            took = upto(lo)
            left = count - sum(took.values())
            for k in sorted(k for k, b in base.items() if b + took[k] * size == lo + 1)[:left]:
                took[k] += 1
            loads = [(b + took[k] * size, k) for k, b in base.items()]
            heapq.heapify(loads)
        ks = sorted(k for k, n in took.items() if n)
        yield size, ks, np.cumsum([took[k] for k in ks]).tolist()


def _planned(groups: DataFrame, shards: int) -> DataFrame:
    """The schedule for groups with group_size, as a staged table."""
    spark, path = groups.sparkSession, new_path(groups.sparkSession, "plan")
    sizes = staged(groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n")), "sizes").orderBy(F.col("group_size").desc())
    steps = schedule(((r.group_size, r.n) for r in sizes.toLocalIterator()), shards)
    while chunk := list(islice(steps, CHUNK)):
        spark.createDataFrame(pd.DataFrame(chunk, columns=["group_size", "to", "upto"]), PLAN).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path) if not groups.isEmpty() else spark.createDataFrame([], PLAN)


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in a shard, by doc_id), grown_shard."""
    data = F.encode("text", "UTF-8")
    rows = staged(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(data, F.lit(b""))).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"null")).alias("digest"),
        ),
        "sized",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_size"))
    numbered = staged(ranked(groups, ["group_size"], ["digest"]), "groups")
    plans = _planned(numbered, shards)
    # Merged, since the plan's rows are as many as there are sizes; Spark would broadcast it by the size of its files.
    placed = numbered.join(plans.hint("merge"), "group_size").select("digest", F.expr("to[size(filter(upto, x -> x <= rank_in_group))]").alias("shard"))
    # The hot digest is on the rows' side; Spark splits it at run time.
    sharded = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard")
    return ranked(sharded, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
