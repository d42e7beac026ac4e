"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights. A shingle of five words weighs tf * idf, idf = 1 + ln(min(N / df, common)); `common` of infinity gives plain idf. df is counted over all
documents in a count-min sketch of two rows of cells; only shingles in over one common-th of all documents differ
from the greatest idf. The cells of a row are a power of two, at least CELLS and sixteen times the mean bytes of a text, so that a cell so full is above
what rare shingles add to it, and MOST_CELLS at most, whatever the corpus.

Samples. Each text gets `2 * bands` samples by improved consistent weighted sampling: per shingle and sample r and c are
Gamma(2, 1) and b uniform, all drawn by the shingle's hash; t = floor(ln(w) / r + b), ln(a) = ln(c) - r * (t - b + 1); the
sample is the (shingle, t) of the least a. Two texts share a sample with the probability of their weighted Jaccard
similarity. Two samples make a band; at 0.8, ten bands miss a pair with probability 4e-5.

Verification. Equal texts are one node. In a bucket, all nodes are compared with the least and the greatest. Of buckets that are then
not all in one component, the nodes get signatures, bits of many further samples, and are dealt into blocks of about PER_NODE. Each two
blocks of a bucket meet in a group of their own, where all pairs of different components are screened by their signatures (a pair at the threshold
is screened out with probability 1e-9) and, if these are
alike, verified, the most alike first and none that earlier links of the group have joined. So no pair is left out because a bucket is large: a
bucket whose n nodes are of many components costs in the order of n * n comparisons of signatures, in groups of bounded size. Links are
pairs whose weighted Jaccard similarity, summed over all shingles, is at least `threshold`; classes are their connected components, found by
repeated joins. Nothing about documents is gathered on the driver but the sketch and bit maps of fixed size.

Null and empty texts are the same text, without shingles, as are texts of the same words only if equal; texts of one to four words have
one shingle. Repeated rows, null and repeated ids are fine: rows of equal text share a class. class_id is the least doc_id of the class (null only
if all are null). An empty table gives no rows; other columns pass through `deduplicate`, whatever their names, and are ignored by `classes`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import batches, mix, shingles

COMMON = 32.0
CELLS, MOST_CELLS = 1 << 16, 1 << 20
#: Nodes of a block: in a group each node is compared with about so many of the other block.
PER_NODE = 1000
#: Bits of a signature, and how many may differ: pairs of similarity 0.8 differ in a bit with probability 0.1, in 51 on average with deviation 6.8.
SIGNATURE, DIFFERENT = 512, 96
LONGS = [f"s{i}" for i in range(SIGNATURE // 64)]
#: Entries of the tables that samples are drawn from, and bits of the map of texts to be compared.
DRAWS = 1 << 16
MAP_BITS = 1 << 23


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a hash, of whose low 32 bits the first row takes the lowest and the second the highest."""
    low, shift = np.uint64(cells - 1), np.uint64(32 - (cells - 1).bit_length())
    return (hashes & low).astype(np.int64), ((hashes >> shift) & low).astype(np.int64)


class Weights:
    """idf by cell of the sketch."""

    def __init__(self, counts: np.ndarray, n: int, common: float = COMMON):
        self.idf = (1 + np.log(np.minimum(max(n, 1) / np.maximum(counts, 1), common))).astype(np.float32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _cells(hashes, self.idf.shape[1])
        return np.maximum(self.idf[0][a], self.idf[1][b])


class Sampler:
    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        u = rng.random((4, DRAWS)) * (1 - 1e-12) + 1e-12
        self.r = (-np.log(u[0] * u[1])).astype(np.float32)
        self.per_r = (1 / self.r).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.b = ((np.arange(DRAWS) + 0.5) / DRAWS).astype(np.float32)
        self.salts = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def __call__(self, starts: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """samples x texts: the sampled (shingle, t), hashed. starts: the first shingle of each text; none is empty."""
        log_w, low = np.log(weights), np.uint64(0xFFFF)
        out = np.empty((len(self.salts), len(starts)), np.uint64)
        for k, salt in enumerate(self.salts):
            x = mix((hashes + salt) * salt)
            i = (x & low).astype(np.intp)
            r, b = self.r[i], self.b[((x >> np.uint64(32)) & low).astype(np.intp)]
            t = np.floor(log_w * self.per_r[i] + b)
            log_a = self.log_c[((x >> np.uint64(16)) & low).astype(np.intp)] - r * (t - b + 1)
            bits = log_a.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # in the order of the numbers
            who = mix(x + t.astype(np.int64).view(np.uint64)) >> np.uint64(32)
            out[k] = np.minimum.reduceat((bits << np.uint64(32)) | who, starts) & np.uint64(0xFFFFFFFF)
        return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("text"), F.unhex(F.sha2(text, 256)).alias("node"))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch, 2 x cells, and the number of documents."""
    mean = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0.0
    size = min(MOST_CELLS, max(CELLS, 1 << int(16 * mean).bit_length()))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros((2, size), np.int64), 0
        for part in parts:
            n += part.num_rows
            for _, _, data, offsets in batches(part.column(0)):
                _, hashes, _ = shingles(data, offsets)
                for row, at in zip(cells, _cells(hashes, size)):
                    row += np.bincount(at, minlength=size)
        flat = np.append(cells.ravel(), n)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "n"])

    found = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 2 * MOST_CELLS + 1 rows at most
    flat = np.zeros(2 * size + 1, np.int64)
    flat[found.cell.to_numpy()] = found.n.to_numpy()
    return flat[:-1].reshape(2, size), int(flat[-1])


def sketches(texts: DataFrame, weights: Weights, bands: int) -> DataFrame:
    """doc_id, node, keys: the band keys of each text, null if it has no shingles."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(2 * bands)
        for part in parts:
            keys = np.zeros((part.num_rows, bands), np.int64)
            some = np.zeros(part.num_rows, bool)
            for lo, _, data, offsets in batches(part.column(1)):
                owner, hashes, often = shingles(data, offsets)
                if len(owner):
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    got = sampler(starts, hashes, weights(hashes) * often.astype(np.float32))
                    both = mix((got[0::2] << np.uint64(32)) | got[1::2]) + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    rows = lo + owner[starts]
                    keys[rows], some[rows] = mix(both).T.view(np.int64), True
            ends = np.append(0, np.cumsum(some) * bands).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(keys[some].ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "node", "keys"])

    return texts.select("doc_id", "text", "node").mapInArrow(sketch, "doc_id long, node binary, keys array<long>")


def _bit(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(MAP_BITS))


def stored_shingles(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (sorted 32-bit hashes, each as often as it occurs) of the wanted (doc_id, node).

    Which texts are wanted goes to the tasks as a map of MAP_BITS bits; a semi join then drops the few others it lets through."""
    bit = _bit("doc_id", "node")
    words = wanted.select(bit.alias("bit")).selectExpr("int(bit div 32) AS at", "shiftleft(1L, int(bit % 32)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(MAP_BITS // 32, np.uint32)  # 1 MB, whatever the data
    bits[words["at"].to_numpy()] = words.bits.to_numpy().astype(np.uint32)

    def store(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.column(3).to_numpy()
            part = part.filter(pa.array((bits[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1))
            for lo, hi, data, offsets in batches(part.column(1)):
                owner, hashes, often = shingles(data, offsets)
                value, owner = np.repeat(hashes.astype(np.uint32), often), np.repeat(owner, often)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                lists = pa.array([np.sort(value[a:z]).tobytes() for a, z in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), part.column(2).slice(lo, hi - lo), lists], ["doc_id", "node", "shingles"])

    found = texts.select("doc_id", "text", "node", bit.alias("bit")).mapInArrow(store, "doc_id long, node binary, shingles binary")
    mine = wanted.select(F.col("doc_id").alias("d"), F.col("node").alias("n"))
    return found.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("n")), "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _weighed(stored: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The different shingles of a stored text, how often each occurs, its weight once, and the weight of all."""
    x, n = np.unique(np.frombuffer(stored, np.uint32), return_counts=True)
    w = weights(x.astype(np.uint64))
    return x, n, w, float(w @ n)


def _similarity(a: tuple, b: tuple) -> float:
    (x, n, _, p), (y, m, wy, q) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    shared = float(wy[same] @ np.minimum(n[at[same]], m[same]))
    return shared / (p + q - shared)


def similarity(a: bytes, b: bytes, weights: Weights) -> float:
    """Weighted Jaccard similarity of two stored texts."""
    return _similarity(_weighed(a, weights), _weighed(b, weights))


def signatures(nodes: DataFrame, stored: DataFrame, weights: Weights) -> DataFrame:
    """node and SIGNATURE bits of it (s0, s1, ...): the lowest bit of each of so many further samples."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(SIGNATURE, seed=23)
        for part in parts:
            for lo in range(0, part.num_rows, 64):
                some = part.slice(lo, 64)
                found = [np.unique(np.frombuffer(x.as_buffer(), np.uint32), return_counts=True) for x in some.column(1)]
                hashes = np.concatenate([h for h, _ in found]).astype(np.uint64)
                starts = np.cumsum([0, *(len(h) for h, _ in found[:-1])])
                bits = sampler(starts, mix(hashes), weights(hashes) * np.concatenate([n for _, n in found]).astype(np.float32)) & np.uint64(1)
                longs = [(bits[64 * i : 64 * i + 64] << np.arange(64, dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64) for i in range(SIGNATURE // 64)]
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, longs)], ["node", *LONGS])

    return stored.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(sign, "node binary, " + ", ".join(f"{c} long" for c in LONGS))


def verified(pairs: DataFrame, stored: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The different (p, q) of the pairs (a, b, p, q) whose texts a and b are alike: what they link."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = [similarity(x.as_buffer(), y.as_buffer(), weights) >= threshold for x, y in zip(part.column(2), part.column(3))]
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = stored.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = stored.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("p", "q", "x", "y").mapInArrow(compare, "p binary, q binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for the nodes of links (p, q)."""
    both = staged(links.select(F.col("p").alias("a"), F.col("q").alias("b")).union(links.select("q", "p")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        # The least label among the neighbours, then the label of that label.
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = staged(low.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels


def _classes(docs: DataFrame, threshold: float, bands: int, common: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and node, doc_id (its least), label (of its component) of each different text."""
    texts = _texts(docs)
    weights = Weights(*document_frequencies(texts), common)
    rows = staged(sketches(texts, weights, bands), "sketches")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n")), "nodes")
    every = nodes.filter("keys IS NOT NULL").select("node", "keys", F.posexplode("keys").alias("band", "bucket")).select("node", "keys", "band", "bucket")
    buckets = staged(_shared(every), "buckets")
    labels = None
    if not buckets.isEmpty():
        wanted = nodes.join(buckets.select("node").distinct(), "node").select("doc_id", "node")
        stored = staged(stored_shingles(texts, wanted), "shingles")
        # Two hubs a bucket: the least and the greatest node.
        ends = [buckets.filter(f"node != {hub}").select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")) for hub in ("hub", "top")]
        pairs = ends[0].union(ends[1]).distinct().withColumn("p", F.col("a")).withColumn("q", F.col("b"))
        labels = components(staged(verified(pairs, stored, weights, threshold), "verified"))
        named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), (F.min("label") != F.max("label")).alias("split")).filter("split").select("bucket", "size")
        left = staged(named.join(split, "bucket").filter("node != hub AND node != top").select("bucket", "band", "node", "label", "keys", "size"), "unresolved")
        if not left.isEmpty():
            signed = staged(signatures(left.select("node").distinct(), stored, weights), "signatures")
            labels = _merged(labels, staged(_linked(left.join(signed, "node").join(stored, "node"), weights, threshold), "linked"))
    return rows, _named(nodes, labels)


def _shared(members: DataFrame) -> DataFrame:
    """The members of buckets of two or more, with the least and the greatest node."""
    ends = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.max("node").alias("top")).filter("size > 1")
    return members.join(ends.drop("size"), "bucket").select("bucket", "band", "node", "hub", "top", "keys")


def _merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after further links: of what was linked before, each node's tie to its label is enough."""
    return components(labels.filter("node != label").select(F.col("node").alias("p"), F.col("label").alias("q")).union(new))


def _linked(members: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The different (p, q): components linked by a pair of alike texts of a bucket.

    Every two blocks of a bucket (and each with itself) are one group; a pair of several shared bands is compared in its first alone."""

    def compare(group: pa.Table) -> pa.Table:
        block, i, j = group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        _, label = np.unique(np.array(group["label"].to_pylist(), object), return_inverse=True)
        names = group["label"]
        signs = np.stack([group[c].to_numpy() for c in LONGS], axis=1).view(np.uint64)
        keys, band = np.array(group["keys"].to_pylist(), np.int64), group["band"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for lo in range(0, len(left), 64):
            x = left[lo : lo + 64]
            apart = np.zeros((len(x), len(right)), np.uint16)
            for k in range(len(LONGS)):
                apart += np.bitwise_count(signs[x, k][:, None] ^ signs[right, k])
            near = (apart <= DIFFERENT) & (label[x][:, None] != label[right])
            if i == j:
                near &= x[:, None] < right
            u, v = np.nonzero(near)
            a, b = x[u], right[v]
            here = (keys[a] == keys[b]).argmax(axis=1) == band
            found.append(np.stack([apart[u, v][here].astype(np.int64), a[here], b[here]], axis=1))
        found = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        parent, texts, links = list(range(len(label))), {}, []

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for a, b in found[np.argsort(found[:, 0], kind="stable"), 1:].tolist():
            p, q = root(label[a]), root(label[b])
            if p != q:
                for n in (a, b):
                    if n not in texts:
                        texts[n] = _weighed(group["shingles"][n].as_buffer(), weights)
                if _similarity(texts[a], texts[b]) >= threshold:
                    parent[p] = q
                    links.append((a, b))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"p": names.take(pa.array(at[:, 0])), "q": names.take(pa.array(at[:, 1]))})

    blocks = F.ceil(F.col("size") / F.lit(PER_NODE)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", "band", "label", "keys", "shingles", *LONGS, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "p binary, q binary").distinct()


def _named(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    named = nodes.select("node", "doc_id", "n")
    if labels is None:
        return named.withColumn("label", F.col("node"))
    return named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, *, threshold: float = 0.8, bands: int = 10, common: float = COMMON) -> DataFrame:
    """doc_id, node (SHA-256 of the text), class_id, class_size (rows): a row per document."""
    rows, named = _classes(docs, threshold, bands, common)
    groups = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    of = named.join(groups, "label").select("node", "class_id", "class_size")
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "node", "class_id", "class_size")


def deduplicate(docs: DataFrame, *, threshold: float = 0.8, bands: int = 10, common: float = COMMON) -> DataFrame:
    """The rows of docs that stay: of each class the one with the least doc_id (null only if all are), of rows equal in
    doc_id and text one. Where several texts of a class share that id, the text with the least SHA-256 stays."""
    rows, named = _classes(docs, threshold, bands, common)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.node").alias("of"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("of"))
    first = staged(rows.join(first, same).groupBy("id", "of").agg(F.count(F.lit(1)).alias("rows")), "first")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("node"))
    kept = keyed.join(first.filter("rows = 1"), same, "left_semi")
    if not first.filter("rows > 1").isEmpty():
        kept = kept.unionByName(keyed.join(first.filter("rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "node"]))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
