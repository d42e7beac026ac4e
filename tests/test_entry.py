import duckdb
import pytest

import __spark_entry__ as entry


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(r.failed < r.n for r in rows)


@pytest.mark.parametrize("name", ["src_strict_text", "agg_entropy_summary"])
def test_whole_documents(spark, tmp_path, name):
    """Against SQL, on documents whose odd bytes and sections come late."""
    noise = "".join(chr(33 + i * 7919 % 90) for i in range(4000))
    texts = [None, "", "a", "plain " * 60, "x" * 150 + "é", "x" * 151 + "é", "a" * 3000 + noise, "ab" * 400 + "\u00ff\u0163" * 3, "a\u06d8bc" * 50, "z" * 200_000 + "é", *(noise[i : i + 97 * i] for i in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if name == "agg_entropy_summary":
        assert {r[0]: r[4] for r in want}[6] > 0
    else:
        assert [r[1] for r in sorted(want)][3:6] == [True, False, False]
