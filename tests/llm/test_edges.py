"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for all operators and all stages of the pipeline."""

import public_tokenizers as PT
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytesmith.llm import bpe, forest, neardup, packing, pii, quality, secrets, sharding, topk, warc
from bytesmith.llm.common import new_path, shared_dir

#: Every name that some operator uses inside, and some results' names.
NAMES = (
    "row no at x new m kind value base entropy mentions entities _s0 _s1 _all _new _mentions _row n_entities _id _of _long _node node keys label bucket band hub top id of rows d digest group_size rank_in_group _part _pos "
    "_first _n _shift evidence site_rate score keep host path _host _path n s host_n host_s rate probability some h p site ids data start length piece chunk run sync block dim v page refers_to payload size shard slot law query_id "
    "query_no rank offset sequence_id doc_tokens ids_crc32 window n_tokens base_spans entropy_spans"
).split()
LONG = "Some words that go on, e-mail a.b@example.com and a few more. " * 4000
TEXTS = [None, "", "Call Mr Smith at +49 30 1234567, please, as soon as you can.", "Call Mr Smith at +49 30 1234567, please, as soon as you can.", "token = abcdef123456", " \n ", LONG, "x" * 50_000, "same words here as there and everywhere else too"]
LABELS = "doc_id long, quality int, toxic int"


def clashing(spark, texts, skip=()):
    """Documents with an extra column of each name, whose values say which row and column they are; the last row is there twice, one id is null."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts) - 1, texts[-1]), (None, "no id")] if texts else []
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 2 == 0, "a"), "n_chars": F.length("text")})
    return docs.select("*", *[F.concat_ws("-", F.lit(c), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in NAMES if c not in skip])


def kept(rows, results):
    for r in rows:
        r = r.asDict()
        for c in NAMES:
            assert c in results or r[c] == f"{c}-{-1 if r['doc_id'] is None else r['doc_id']}", c
    return rows


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(n)], LABELS)


THROUGH = {
    "pii": (lambda s, d: pii.pseudonymise(d, "key"), {"n_entities"}),
    "secrets": (lambda s, d: secrets.scan(d), {"base_spans", "entropy_spans"}),
    "quality": (lambda s, d: quality.classify(d, labels(s, 9)), {"evidence", "site_rate", "score", "keep"}),
    "neardup": (lambda s, d: neardup.deduplicate(d), set()),
}


@pytest.mark.parametrize("name", THROUGH)
def test_columns_pass_through(spark, name):
    run, results = THROUGH[name]
    docs = clashing(spark, TEXTS)
    rows = kept(run(spark, docs).collect(), results)
    n = len(TEXTS) + 2
    assert len(rows) == (n - 3 if name == "neardup" else n)  # a null and an empty text are the same; so are the equal texts and the repeated row
    assert run(spark, clashing(spark, [])).collect() == []
    if name == "pii":
        mine = {r.doc_id: (r.text, r.n_entities) for r in rows}
        assert mine[0] == (None, 0) and mine[1] == ("", 0) and mine[2] == mine[3] and mine[2][1] == 2 and mine[6][1] == 4000 and mine[7] == (TEXTS[7], 0) and len(mine[6][0]) == len(LONG)


OTHERS = {
    "bpe": (lambda s, d: bpe.decode(bpe.encode(d, PT.path("byte_bpe_multi_50k.tiktoken"), PT.PATTERN, chunk=3000, overlap=100), PT.path("byte_bpe_multi_50k.tiktoken")), len(TEXTS) + 2),
    "sharding": (lambda s, d: sharding.shard_documents(d, 3), len(TEXTS) + 2),
    "packing": (lambda s, d: packing.pack(d, PT.path("word_bpe_49k.json")).select("doc_id", "start").filter("start = 0"), len(TEXTS) + 2),
    "classes": (lambda s, d: neardup.classes(d), len(TEXTS) + 2),
}


@pytest.mark.parametrize("name", OTHERS)
def test_columns_are_ignored(spark, name):
    run, n = OTHERS[name]
    rows = run(spark, clashing(spark, TEXTS)).collect()
    assert len(rows) == n
    assert run(spark, clashing(spark, [])).collect() == []
    if name == "bpe":
        assert {bytes(r.data).decode() for r in rows} == {t or "" for t in TEXTS} | {"no id"}


@pytest.mark.parametrize("search", [forest.nearest, topk.top_k])
def test_vectors_beside_clashing_columns(spark, search):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(0, [0.0, 1.0]), (None, [1.0, 1.0]), (31, None), (32, [None, 1.0]), (33, [float("nan"), 1.0]), (34, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(c).alias(c) for c in NAMES])
    got = search(df, df.filter("vec_id = 0"), 5).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5] and {r.query_id for r in got} == {0} and 0 not in {r.vec_id for r in got}
    assert search(df.limit(0), df.limit(0), 5).collect() == []


def test_pages_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "a" * 1000), (2, None, "a" * 1000), (2, None, "a" * 1000), (None, "u", None)], "page_id long, url string, html string")
    df = df.select("*", *[F.lit(c).alias(c) for c in NAMES])
    out = new_path(spark, "warc-test")
    warc.write_warc(df, out)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_warc(spark, out).collect()) == [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "response", None)]
    warc.write_warc(df.limit(0), out := new_path(spark, "warc-test"))
    assert warc.read_warc(spark, out).collect() == []


def test_stages(spark, tmp_path):
    """All stages on clashing columns, and on empty tables one after the other."""
    labels(spark, 9).write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(spark, TEXTS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = kept(stage(spark, docs, str(tmp_path)).collect(), set())
        assert rows and list(rows[0].asDict()) == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(TEXTS) + 2
    empty = tmp_path / "empty"
    labels(spark).write.parquet(str(empty / "labels.parquet"))
    clashing(spark, []).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    context = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None, "applicationId": "a"})()
    session = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, k, d=None: None})(), "sparkContext": context})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
