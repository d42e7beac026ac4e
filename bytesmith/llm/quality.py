"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence. A logistic regression over what a text's bytes and words show (shares of character classes, word lengths, repeats)
is fitted on at most SAMPLE labelled rows, those whose hashed ids are least; its output is a document's log odds of good quality.

Hierarchy. Over all documents, grouped sums give each host and each path its count and its sum of expected good
documents, by the classifier's probabilities. A host's rate is shrunk towards the global
rate, a path's towards its host's, by Beta priors whose strength is estimated by moments from how much sites differ beyond chance;
sparse sites stay at their parent's rate. A document's own part is taken out of its site's sums. The posterior log odds are
the evidence plus `site_weight` times the path's log odds over the global ones; documents below `bound` are rejected.

Host and path are given as columns (for documents, source and lang). Nulls in them are sites of their own. A null or empty
text, or one without words, is rejected: score 0. Repeated rows, ties and null ids are scored as they are. Rows whose doc_id has several labels
count with their mean. An empty table gives no rows. Where documents have no labels of both kinds nothing can be fitted: texts with words then have
evidence 0, sites say nothing, and score is 0.5. Other columns pass through, whatever their names, but for any called evidence,
site_rate, score or keep, which the results replace.

The labelled sample is found in one pass, by a broadcast of at most SAMPLE ids; evidence is computed in a second, which stages it beside the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import HASH_BITS, batches, words

SAMPLE = 20_000
#: Byte classes that are counted: each character of the first string by itself, then the groups.
SINGLE = "!#$%&*|.,?;:\"'()-_/\\@<>={}[]+~^`"
GROUPS = ("lower", "upper", "digit", "high", "space", "line", "control")
N_CLASSES = len(SINGLE) + len(GROUPS)


def _classes() -> np.ndarray:
    at = {name: len(SINGLE) + i for i, name in enumerate(GROUPS)}
    out = np.full(256, at["control"], np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = at["high"] if b > 127 else at["lower"] if c.islower() else at["upper"] if c.isupper() else at["digit"] if c.isdigit() else at["line"] if c == "\n" else at["space"] if c.isspace() else out[b]
    for i, c in enumerate(SINGLE):
        out[ord(c)] = i
    return out


_CLASS = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text; all zero for a text without words."""
    sizes = np.diff(offsets)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    spaced = np.full(len(data) + n, 32, np.uint8)
    spaced[np.arange(len(data)) + owner] = data
    hashes, begin = words(spaced)
    mine = np.searchsorted(offsets[:-1] + np.arange(n), begin, "right") - 1
    n_words = np.bincount(mine, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    twice = np.bincount(mine[1:][(hashes[1:] == hashes[:-1]) & (mine[1:] == mine[:-1])], minlength=n)
    key = np.sort((mine.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)
    bytes_ = np.maximum(sizes, 1).astype(float)
    per_word = np.log1p(counts / some[:, None] * 20)
    letters = counts[:, [len(SINGLE), len(SINGLE) + 1, len(SINGLE) + 3]].sum(axis=1)
    more = np.stack([np.log1p(n_words), letters / bytes_, counts[:, len(SINGLE) + 1] / np.maximum(letters, 1), letters / some, twice / some, np.sqrt(twice / some), distinct / some,
                     (distinct / some) * np.log1p(n_words), counts[:, len(SINGLE) + 5] / some], axis=1)
    return np.hstack([per_word, more, more[:, 1:] ** 2]) * (n_words > 0)[:, None]


def features_of(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.string()).fill_null("")
    parts = [features(data, offsets) for _, _, data, offsets in batches(texts)]
    return np.vstack(parts) if parts else np.zeros((0, 0))


class Logistic:
    """Logistic regression on standardised features, by Newton's method with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 40):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._with_one(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.std, -8, 8)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._with_one(x) @ self.w, -30, 30)


class Unfitted:
    """What stands for the classifier where there are no labels of both kinds."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Logistic | Unfitted:
    """The classifier, from at most `sample` labelled documents (the least by hashed id)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(chosen, F.col("doc_id") == F.col("id")).select("label", "text")

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = features_of(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    found = rows.mapInArrow(look, "label double, x array<double>").toPandas()  # `sample` rows, more only where ids repeat
    y = found.label.to_numpy(float)
    if not len(found) or len(set((y > 0.5).tolist())) < 2:
        return Unfitted()
    order = np.lexsort(np.stack(found.x.to_numpy()).T[::-1])  # the same sums in any order of the rows
    return Logistic(np.stack(found.x.to_numpy())[order], y[order])


def evidence_udf(model: Logistic | Unfitted):
    """Log odds of good quality by the text alone."""

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        x = features_of(texts)
        return pa.array(np.where(x.any(axis=1), model(x), NO_WORDS) if len(x) else np.zeros(0))

    return evidence


#: The evidence of a text without words.
NO_WORDS = -30.0


@dataclass(frozen=True)
class Priors:
    """The global rate, and how many documents a parent's rate counts for at a host and at a path."""

    rate: float
    host: float
    path: float


def _strength(spread: float, chance: float, scale: float, variance: float) -> float:
    """Of a Beta prior, by moments: how much the rates of sites differ beyond chance."""
    between = max(0.0, (spread - chance) / scale) if scale > 0 else 0.0
    return float(np.clip(variance / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def sites(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """host, path, their counts and sums, from rows with host, path and evidence; and the priors."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = staged(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("decimal(30,12)")).cast("double").alias("s")), "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    both = staged(paths.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h"), "sites")
    top = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    if not top.n:
        return both, Priors(0.5, 1e6, 1e6)
    rate = float(np.clip(top.s / top.n, 1e-4, 1 - 1e-4))
    h = hosts.agg(F.sum(F.col("host_n") * (F.col("host_s") / F.col("host_n") - rate) ** 2).alias("spread"), F.count(F.lit(1)).alias("k"), F.sum(F.col("host_n") * F.col("host_n")).alias("squares")).first()
    at_host = F.col("host_s") / F.col("host_n")
    p = both.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - at_host) ** 2).alias("spread"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n") / F.col("host_n")).alias("squares")).first()
    v = rate * (1 - rate)
    return both, Priors(rate, _strength(h.spread, (h.k - 1) * v, top.n - h.squares / top.n, v), _strength(p.spread, (p.k - h.k) * v, top.n - p.squares, v))


RESULTS = ("evidence", "site_rate", "score", "keep")


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", label: str = "quality", site_weight: float = 1.0, bound: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """docs with `evidence`, `site_rate`, `score` (the posterior probability of good quality) and `keep`.

    carry: the columns of docs that are wanted in the result, all if None. The table of sites meets the documents in a join on (host, path): Spark
    broadcasts it only below its own size threshold, and else splits a site that fills many rows."""
    model = fit(docs, labels, label)
    evidence, site_weight = evidence_udf(model), 0.0 if isinstance(model, Unfitted) else site_weight
    kept = [c for c in docs.columns if c not in RESULTS and (carry is None or c in carry)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept or docs.columns[:1]]).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col("text"))
    scored = staged(rows.select("row", "host", "path", evidence("text").alias("evidence")), "evidence")
    table, priors = sites(scored.select("host", "path", "evidence"))
    table = table.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct("n", "s", "host_n", "host_s").alias("site"))
    joined = scored.join(table, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    mine = 1 / (1 + F.exp(-F.col("evidence")))
    at_host = (F.col("site.host_s") - mine + priors.host * priors.rate) / (F.col("site.host_n") - 1 + priors.host)
    at_path = (F.col("site.s") - mine + priors.path * at_host) / (F.col("site.n") - 1 + priors.path)
    odds = lambda p: F.log(p / (1 - p))
    joined = joined.withColumn("rate", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), at_path)))
    posterior = F.col("evidence") + site_weight * (odds(F.col("rate")) - float(np.log(priors.rate / (1 - priors.rate))))
    score = F.when(F.col("evidence") <= NO_WORDS, F.lit(0.0)).otherwise(1 / (1 + F.exp(-posterior)))
    return joined.withColumn("probability", score).select(*[F.col(f"row.`{c}`") for c in kept], "evidence", F.col("rate").alias("site_rate"), F.col("probability").alias("score"), (F.col("probability") >= bound).alias("keep"))
