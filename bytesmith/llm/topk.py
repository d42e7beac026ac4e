"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Components are floor(1024 * x). In a block of rows, each dimension has two posting lists, by descending and by
ascending value, cut into segments of equal quantised impact. For a query, a component's contribution is
taken over the least that the dimension can give, so that contributions are never negative; segments of all
dimensions are processed by descending impact, adding each row's lower bound. What a row can still gain is at most
the sum over dimensions of the impact at which each list stands, and the widths of the segments. Segments are taken in rounds of
falling impact; after a round, rows whose upper bound is below the k-th lower bound are ruled out for good. Processing stops
once that proof leaves few rows, or when all segments are done; all rows not ruled out are then scored
exactly in 64-bit integers; components or scores that wouldn't fit are an error.

Null, empty and non-finite vectors, unequal lengths, repeated rows and ids, ties, empty tables and clashing names are treated as blocks.py says."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of_blocks, smallest, usable


class ImpactIndex:
    """Posting segments of one block of integer vectors: for each dimension the rows by level of their component."""

    def __init__(self, rows: np.ndarray, levels: int = 64):
        self.rows, self.levels = rows, levels
        d = rows.shape[1]
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.greatest = float(max(np.abs(self.low.astype(float)).max(), np.abs(self.high.astype(float)).max(), (self.high.astype(float) - self.low).max()))
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        level = (rows - self.low) // self.step
        self.order = np.ascontiguousarray(np.argsort(level, axis=0, kind="stable").T)
        self.cut = np.stack([np.searchsorted(level[self.order[j], j], np.arange(levels + 1)) for j in range(d)])
        self.sizes = np.diff(self.cut, axis=1)
        self.floor = self.low[:, None] + self.step[:, None] * np.arange(levels)
        self.ceil = np.maximum(self.floor, np.minimum(self.floor + self.step[:, None] - 1, self.high[:, None]))

    def best(self, q: np.ndarray, k: int, skip: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Positions not ruled out of the k best, with exact scores; skip: positions that aren't candidates."""
        n, d = self.rows.shape
        up, w = (q > 0)[:, None], np.abs(q)[:, None]
        # A segment's impact lies from `least` to `most`; a list begins at its end of greatest impact.
        least = np.maximum(0, np.where(up, self.floor - self.low[:, None], self.high[:, None] - self.ceil)) * w
        most = np.maximum(0, np.where(up, self.ceil - self.low[:, None], self.high[:, None] - self.floor)) * w
        bounds = np.sort(most[self.cut[:, 1:] > self.cut[:, :-1]])[::-1]
        bounds = [int(bounds[len(bounds) * (r + 1) // rounds - 1]) for r in range(rounds)]
        gain, width = np.zeros(n, np.int64), int((most - least).max(axis=1).sum())
        done = np.zeros(d, np.int64)  # segments of each list that are processed
        free = np.setdiff1d(np.arange(n), skip, assume_unique=True)
        for bound in bounds:
            upto = (most >= bound).sum(axis=1)  # impacts are monotonic in the level, so these are each list's next segments
            for j in np.flatnonzero(upto > done):
                a, b = (self.levels - upto[j], self.levels - done[j]) if q[j] > 0 else (done[j], upto[j])
                rows = self.order[j, self.cut[j, a] : self.cut[j, b]]  # a row is once in a list
                gain[rows] += least[j, a:b].repeat(self.sizes[j, a:b])
            done = np.maximum(done, upto)
            at = np.where(q > 0, self.levels - 1 - done, done)
            rest = int(np.where(done < self.levels, np.take_along_axis(most, np.clip(at, 0, self.levels - 1)[:, None], 1)[:, 0], 0).sum())
            if len(free) > k:
                lower = gain[free]
                free = free[lower + (rest + width) >= np.partition(lower, len(free) - k)[len(free) - k]]
            if len(free) <= max(4 * k, n // 64):
                break
        return free, self.rows[free] @ q


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = 1024, levels: int = 64, block_rows: int = 8192) -> DataFrame:
    """The k highest inner products of each query with all rows but those with its id, exactly."""

    def index(ids: np.ndarray, x: np.ndarray):
        posted, size = ImpactIndex(_whole(x, scale), levels), x.shape[1]

        def search(qids: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for qid, v in zip(qids, _whole(q, scale)):
                if float(np.abs(v).max()) * posted.greatest * size >= LARGE:
                    raise OverflowError(f"a score of query {qid} may not fit into 64 bits")
                free, scores = posted.best(v, k, np.flatnonzero(ids == qid))
                best = smallest(-scores, ids[free], k)
                out.append((ids[free][best], scores[best]))
            return out

        return search

    return best_of_blocks(usable(queries), usable(rows), index, k, score="long", largest=True, block_rows=block_rows)


#: Scores and bounds below this fit into 64 bits with room for their sums.
LARGE = float(1 << 60)


def _whole(m: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(m * scale)
    if np.abs(scaled).max(initial=0) >= LARGE:
        raise OverflowError("a component is too large for 64 bits")
    return scaled.astype(np.int64)
