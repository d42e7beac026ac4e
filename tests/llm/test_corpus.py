"""Sharding, near duplicates, searches, WARC and the pipeline: against brute force and round trips."""

import hashlib
import heapq
import math
import os
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytesmith.llm import forest, neardup, sharding, topk, warc
from bytesmith.llm.common import new_path, ranked
from bytesmith.llm.shingles import batches, shingles, words


TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def docs_of(spark, texts, extra="node"):
    return spark.createDataFrame([(i, t, "e", "en", "s", 1) for i, t in enumerate(texts)], f"doc_id long, text string, {extra} string, lang string, source string, n_chars long")


def test_ranked(spark):
    df = spark.createDataFrame([(x % 3 if x % 5 else None, x // 2) for x in range(200)], "g long, v long")
    got = ranked(df, ["g"], ["v"]).toPandas()
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("rank_in_group")
        assert part.rank_in_group.tolist() == list(range(len(part))) and part.v.is_monotonic_increasing


def test_schedule_is_that_of_a_heap():
    sizes = [(90, 1), (40, 3), (9, 1000), (8, 7), (5, 500), (1, 2)]
    heap = [(0, k) for k in range(5)]
    for s, n in sizes:
        for _ in range(n):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + s, k))
    want = {k: load for load, k in heap}
    got = dict.fromkeys(range(5), 0)
    for size, to, upto in sharding.schedule(iter(sizes), 5):
        for k, n in zip(to, np.diff([0, *upto])):
            got[k] += size * int(n)
    assert got == want


def test_shards(spark):
    rng = np.random.default_rng(2)
    texts = [None, None, "", "", "é", *["hot"] * 300, *("w" * int(n) for n in rng.integers(0, 60, 400)), *(f"text {i}" for i in range(200))]
    got = sharding.shard_documents(docs_of(spark, texts, "digest"), 7).toPandas().set_index("doc_id").loc[range(len(texts))]
    assert got["size"].tolist() == [8 + len((t or "").encode()) for t in texts] and got.text_crc32.tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    of = {}
    for t, s in zip(texts, got.shard):
        assert of.setdefault(t, s) == s
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + 8 + len((t or "").encode())
    heap = [0] * 7
    for g in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + g)
    assert sorted(got.groupby("shard")["size"].sum()) == sorted(heap) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert sharding.shard_documents(docs_of(spark, texts).limit(0)).count() == 0


def vectors(spark, extra=True):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:600] = x[300]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1100, [float("nan")] * 12), (1200, [0.0] * 12), (1300, [None] * 12), (1400, [float("inf")] * 12), (1500, []), (1600, [1.0, 2.0]), (1700, [1.0, 2.5])] if extra else []
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1)), x


def test_topk_is_exact(spark):
    df, x = vectors(spark)
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), 10, block_rows=200).toPandas()
    q = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    for i in range(0, 900, 100):
        s = q @ q[i]
        want = sorted((-s[j], j) for j in range(900) if j != i)[:10]
        mine = got[got.query_id == i].sort_values("rank")
        zeros = [(0, 1200)] if -want[-1][0] < 0 else []
        assert [(-a, b) for a, b in zip(mine.score, mine.vec_id)] == sorted(want + zeros)[:10] and mine["rank"].tolist() == list(range(1, 11))
    assert got[got.query_id == 1600].vec_id.tolist() == [1700] and set(got.query_id) == {*range(0, 900, 100), 1200, 1600, 1700}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(0, [1e10, 1.0]), (1, [1e10, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, df).collect()


def test_forest_with_production_parameters(spark):
    """Recall at 10 over the given vectors, which hardly cluster, with the query's own parameters."""
    from bytesmith.llm.queries import op6_forest

    for sf in ("sf0.001", "sf0.1"):
        rows = spark.read.parquet(f"{TESTDATA}/{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas().dropna()
        x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
        got = op6_forest(spark, f"{TESTDATA}/{sf}").toPandas()
        hits = total = 0
        for i in np.flatnonzero(ids % 100 == 0):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            want = set(ids[np.lexsort((ids, d))[:10]].tolist())
            hits, total = hits + len(want & set(got[got.query_id == ids[i]].vec_id)), total + 10
        assert hits >= 0.9 * total, (sf, hits, total)


def test_index_proves_its_bound():
    rng = np.random.default_rng(9)
    rows = rng.integers(-600, 600, (3000, 16))
    index = topk.ImpactIndex(rows)
    for q in rng.integers(-600, 600, (20, 16)):
        free, scores = index.best(q, 5, np.array([7]))
        exact = rows @ q
        exact[7] = -(1 << 60)
        assert sorted(scores)[-5:] == sorted(exact)[-5:] and len(free) < 3000
    same = topk.ImpactIndex(np.ones((50, 3), np.int64))
    assert len(same.best(np.array([1, 0, -2]), 5, np.array([], int))[0]) == 50


def test_forest_recall(spark):
    df, x = vectors(spark)
    got = forest.nearest(df, df.filter("vec_id % 100 = 0"), 10, least=150, share=0.35, block_rows=400).toPandas()
    d = np.sqrt(((x[::100, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(-1))
    hits = 0
    for i in range(9):
        d[i, i * 100] = np.inf
        mine = got[got.query_id == i * 100].sort_values("rank")
        assert len(mine) == 10 and np.allclose(mine.score, d[i][mine.vec_id], rtol=0, atol=1e-12)
        want = sorted((d[i][j], j) for j in range(900))[:10]
        hits += len({j for _, j in want} & set(mine.vec_id))
    assert hits >= 0.9 * 90
    assert got[got.query_id == 300].vec_id.tolist() == list(range(301, 311))  # copies: all at no distance, smallest ids first
    assert not set(got.query_id) & {1000, 1100, 1200, 1300, 1400, 1500}
    assert forest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_shingles_equal_plain_ones():
    texts = ["", "one", "one two three four five six one two three four five", "a,b;c-d e\nf g", "é1 ö2 x y z w", "same same same same same same"]
    arr = pa.array(texts, pa.string()).slice(0)
    for _, _, data, offsets in batches(arr):
        owner, hashes, often = shingles(data, offsets)
    import re

    for i, t in enumerate(texts):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode())
        plain = {}
        for j in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[j : j + 5])
            plain[s] = plain.get(s, 0) + 1
        assert sorted(often[owner == i]) == sorted(plain.values())
    assert len(set(hashes.tolist())) == len(hashes) - 0
    big = np.frombuffer(b"word " * 900_000, np.uint8)
    assert len(words(big)[0]) == 900_000 and len(set(words(big)[0].tolist())) == 1


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(50))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.integers(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 5)):
            copy = list(base)
            for _ in range(rng.integers(0, 5)):
                copy[rng.integers(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(120)]
    for i in range(90):  # a large group of copies, some too far from the first
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.integers(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    return [*texts, None, "", "", "one two", "One  two!", "three words here", texts[0], texts[0].upper()]


def brute_classes(spark, texts):
    n = len(texts)
    frequencies, rows = neardup.document_frequencies(neardup._texts(docs_of(spark, texts)))
    weights = neardup.Weights(frequencies, rows)
    sets = {}
    for lo, hi, data, offsets in batches(pa.array([(t or "").lower() for t in texts], pa.string())):
        owner, hashes, often = shingles(data, offsets)
        for i in range(lo, hi):
            at = owner == i - lo
            sets[i] = np.sort(np.repeat(hashes[at].astype(np.uint32), often[at])).tobytes()
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(n), 2):
        if (texts[a] or "") == (texts[b] or "") or neardup.similarity(sets[a], sets[b], weights) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(n)]


def plain_classes(texts, common=32.0, threshold=0.8):
    """Classes by plain Python, without the operator's hashes, sketch or weights: all pairs, with document frequencies counted exactly."""
    import re
    from collections import Counter

    def shingled(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = [shingled(t) for t in texts]
    df = Counter(x for b in bags for x in b)
    idf = {x: 1 + math.log(min(len(texts) / n, common)) for x, n in df.items()}
    total = [sum(n * idf[x] for x, n in b.items()) for b in bags]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        shared = sum(min(n, bags[b][x]) * idf[x] for x, n in bags[a].items() if x in bags[b])
        if (texts[a] or "") == (texts[b] or "") or shared and shared / (total[a] + total[b] - shared) >= threshold:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(len(texts))]


def large_groups(seed=9):
    """Families of copies of copies, whose links form chains and several components that share most of their words."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    common = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        base = common + [word() for _ in range(60)]
        for _ in range(25):
            texts.append(" ".join(base))
            for _ in range(rng.integers(0, 3)):
                base[rng.integers(len(base))] = word()
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize(("make", "per_node"), [(lambda: corpus(), 1000), (large_groups, 1000), (large_groups, 20)])
def test_near_duplicates_equal_plain_python(spark, monkeypatch, make, per_node):
    monkeypatch.setattr(neardup, "PER_NODE", per_node)
    texts = make()
    got = neardup.classes(docs_of(spark, texts)).toPandas().set_index("doc_id").loc[range(len(texts))]
    want = plain_classes(texts)
    assert got.class_id.tolist() == want and len(set(want)) > 5 and max(want.count(c) for c in set(want)) > 8


@pytest.mark.parametrize("per_node", [1000, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, per_node):
    monkeypatch.setattr(neardup, "PER_NODE", per_node)
    texts = corpus()
    got = neardup.classes(docs_of(spark, texts)).toPandas().set_index("doc_id").loc[range(len(texts))]
    want = brute_classes(spark, texts)
    assert got.class_id.tolist() == want
    assert got.class_size.tolist() == [want.count(c) for c in want]


def test_large_bucket_of_the_last_band_is_compared_whole(spark, monkeypatch):
    """One bucket, of the only band, with many more pairs across components than PER_NODE a node."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(90):
        base = [f"w{n}" for n in rng.integers(0, 5000, 50)]
        texts += [" ".join(base), " ".join(base[:-1] + ["other"])]
    plain = neardup.sketches
    monkeypatch.setattr(neardup, "PER_NODE", 20)
    monkeypatch.setattr(neardup, "sketches", lambda *a: plain(*a).withColumn("keys", F.array(F.lit(7).cast("long"))))
    got = neardup.classes(docs_of(spark, texts), bands=1).toPandas().set_index("doc_id").loc[range(len(texts))]
    assert got.class_id.tolist() == brute_classes(spark, texts) == [i - i % 2 for i in range(len(texts))]


def test_deduplicate(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z", None, "", "other words that differ here"]
    rows = docs_of(spark, texts).unionByName(docs_of(spark, texts).limit(1)).unionByName(spark.createDataFrame([(None, "x y z", "e", "en", "s", 1)], docs_of(spark, texts).schema))
    kept = neardup.deduplicate(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5]
    assert neardup.deduplicate(rows.limit(0)).count() == 0


def test_samples_meet_as_often_as_similarity_says():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 44, 400, dtype=np.uint64))
    y = np.sort(np.concatenate([x[:300], rng.integers(0, 1 << 44, 100, dtype=np.uint64)]))
    weigh = lambda z: 1 + (z % np.uint64(7)).astype(np.float32)
    shared = weigh(x[:300]).sum()
    j = shared / (weigh(x).sum() + weigh(y).sum() - shared)
    s = neardup.Sampler(3000)
    met = (s(np.array([0]), x, weigh(x)) == s(np.array([0]), y, weigh(y))).mean()
    assert abs(met - j) < 4 * math.sqrt(j * (1 - j) / 3000)


def pages(spark):
    same, short = "<p>" + "é" * 600, "tiny"
    rows = [(1, "http://a/1", same), (2, "http://a/2\n", same), (9, None, same), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (7, "u", "b" * 1000), (7, "u", "b" * 1000), (8, "u", "b" * 1000), (None, "u", "c" * 2000), (10**15, "u", "c" * 2000)]
    rows += [(100 + i, f"u{i}", "x" * (i * 37 % 3000)) for i in range(200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    contents = []
    for _ in range(2):
        out = new_path(spark, "warc-test")
        manifest = warc.write_warc(df, out, shard_bytes=50_000, roll_bytes=2_000).orderBy("file").collect()
        assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
        contents.append([(m.file, m.file_sha256) for m in manifest])
        got = warc.read_warc(spark, out).collect()
    assert contents[0] == contents[1]  # the same bytes again
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and p != top[h or ""]
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_warc_shards_of_skewed_ids(spark):
    """Far outliers, null ids and one id with many pages still give shards of about the wanted bytes, in order."""
    ids = [*range(400), 10**15, -(10**17), *[None] * 100, *[77] * 100]
    rows = spark.createDataFrame([(i, "u", f"{n} " + "x" * 500) for n, i in enumerate(ids)], "page_id long, url string, html string")
    out = new_path(spark, "warc-test")
    manifest = warc.write_warc(rows, out, shard_bytes=20_000, roll_bytes=1 << 30).collect()
    assert len(manifest) > 30 and max(m.records for m in manifest) <= 20 and sum(m.records for m in manifest) == len(ids)
    got = [(r.file, r.page_id is not None, r.page_id or 0) for r in warc.read_warc(spark, out).collect()]
    assert sorted(got) == sorted(got, key=lambda r: (r[1], r[2], r[0]))
    ranges = warc.Ranges([0, (5 + (1 << 63)) << 64, ((5 + (1 << 63)) << 64) | 9, (7 + (1 << 63)) << 64])
    assert ranges.locate(np.array([-3, 5, 5, 6, 7]), np.array([1, 8, 9, 0, 0], np.uint64)).tolist() == [0, 1, 2, 2, 3]


def test_warc_refuses_damage(spark):
    record = warc._record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"payload"
    for broken in (record.replace(b"payload\r", b"PAYLOAD\r"), record[:-3], b"junk"):
        with pytest.raises(ValueError):
            warc.parse_record(broken)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(zlib.compress(b"x", wbits=31)[:-4]))


def test_warc_of_nothing(spark):
    out = new_path(spark, "warc-test")
    assert warc.write_warc(pages(spark)[0].limit(0), out).count() == 0


def test_pipeline(spark):
    sf = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "pack":
            assert docs.columns == before.columns, name
        docs.write.parquet(path := new_path(spark, name))
        docs = spark.read.parquet(path)
    assert docs.count() == corpus_pipeline.run(spark, sf).count()
    kept = docs.select("doc_id").distinct().count()
    assert 0.5 * before.count() < kept < before.count()


def test_pipeline_by_plain_rules(spark):
    """Each stage on its predecessor's rows, against plain Python: the posterior's bound, classes of all pairs, mentions replaced, ids of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from bytesmith.llm import pii, quality

    sf = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = spark.createDataFrame(stages["classify"](spark, docs, sf).collect(), docs.schema)
    assert ids(kept) == sorted(r.doc_id for r in scored if r.score >= 0.5)

    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    classes = plain_classes([r.text for r in rows])
    single = spark.createDataFrame(stages["deduplicate"](spark, kept, sf).collect(), docs.schema)
    assert ids(single) == [r.doc_id for i, r in enumerate(rows) if classes[i] == i]

    replaced = spark.createDataFrame(stages["replace_personal_data"](spark, single, sf).collect(), docs.schema)
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, replaced))
    found = {r.doc_id: r.n for r in single.selectExpr("doc_id", f"size(filter(transform(regexp_extract_all(text, {pii._sql(pii.MENTION)}, 0), m -> {pii.kind_of('m')}), k -> k IS NOT NULL)) AS n").collect()}
    assert all((before[i].text != after[i].text) == (found[i] > 0) and after[i].n_chars == len(after[i].text) for i in before) and sum(found.values()) > 0

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["pack"](spark, replaced, sf).toPandas()
    for i, r in after.items():
        mine = pieces[pieces.doc_id == i].sort_values("start")
        want = np.array([*whole.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert mine.length.sum() == len(want) and mine.ids_crc32.tolist() == [zlib.crc32(want[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)]
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
