"""Approximate nearest neighbours by a hash-prefix forest.

Each block of rows has a forest of its own: a tree is the sorted array of the rows' long hash strings, 64 bits
each, a bit being the side of a random hyperplane through the median of a sample of the block. A query descends each tree to the
rows with the longest prefix in common and then all trees ascend together, one prefix bit at a time, until
`candidates` different rows are marked; all rows of the last level count, so ties in the prefix are never cut.
The marked rows are scored exactly. Every row is in every tree of its block; copies of one vector share
all prefixes, so a group of copies is found whole, and the smallest ids among them win.

Null, empty, zero and non-finite vectors, unequal lengths, repeated rows and ids, empty tables and clashing names are treated as blocks.py says.
How much of a block must be marked for a recall of 0.9 depends on the vectors: the more they cluster, the smaller `share` can be."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of_blocks, smallest, usable

BITS = 64


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, seed: int = 7, sample: int = 2048):
        """sample: rows that the hyperplanes' medians are taken from; all rows are indexed."""
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, rows.shape[1], BITS)).astype(np.float64)
        some = rows[np.linspace(0, len(rows) - 1, min(sample, len(rows))).astype(int)]
        self.medians = np.stack([np.median(some @ p, axis=0) for p in self.planes])
        self.n = len(rows)
        codes = self.hashes(rows)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order.astype(np.int64), axis=1)

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((rows @ p > m) * weights).sum(axis=1, dtype=np.uint64) for p, m in zip(self.planes, self.medians)])

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query, the positions marked when the trees have ascended far enough."""
        codes = self.hashes(queries)
        levels = []
        for bits in range(BITS + 1):  # the range of rows that share so many leading bits, in each tree
            low_mask = np.uint64((1 << (BITS - bits)) - 1)
            lo, hi = codes & ~low_mask, codes | low_mask
            levels.append((np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, lo)]), np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, hi)])))
            if (levels[-1][1] - levels[-1][0]).max() <= 1:
                break  # no prefix this long is shared by two rows; longer ones add nothing
        wanted = min(wanted, self.n)
        for i in range(len(queries)):
            marked = np.zeros(self.n, bool)
            for lo, hi in reversed(levels):
                sizes = hi[:, i] - lo[:, i]
                if sizes.sum() >= wanted or sizes.max() == self.n:
                    for t in np.flatnonzero(sizes):
                        marked[self.order[t, lo[t, i] : hi[t, i]]] = True
                    if np.count_nonzero(marked) >= wanted:
                        break
            yield np.flatnonzero(marked)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, *, trees: int = 48, share: float = 0.4, least: int = 64, block_rows: int = 8192) -> DataFrame:
    """The k nearest found of each query. At least `least` rows of a block and `share` of them are marked and scored.

    A zero vector takes no part. Scores are Euclidean distances in double precision, of the original vectors."""

    def index(ids: np.ndarray, x: np.ndarray):
        forest = Forest(x, trees)

        def search(qids: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for i, near in enumerate(forest.candidates(q, max(least, int(share * len(x))))):
                near = near[ids[near] != qids[i]]
                d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                best = smallest(d, ids[near], k)
                out.append((ids[near][best], d[best]))
            return out

        return search

    some = lambda df: usable(df).filter(F.exists("v", lambda x: x != 0))
    return best_of_blocks(some(queries), some(rows), index, k, score="double", largest=False, block_rows=block_rows)
