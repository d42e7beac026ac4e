"""Registered queries of the byte operators against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from bytesmith.plans import byte_queries

SMALL = os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", [*byte_queries.QUERIES, "src_interpretations", "fn_guess", "fn_hints", "dsl_candidates", "dsl_suggested_names", "jn_deepest_field", "fn_decode_base64", "snk_tree_text"])
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert mine == sorted(want, key=key) and (mine or name == "jn_touched")


@pytest.mark.parametrize("name", ["jn_tree_diff", "jn_deepest_field"])
def test_records_of_equal_lines(spark, tmp_path, name):
    """Lines that are equal in all columns are records of their own, and no record crosses an exchange."""
    lines = spark.read.parquet(SMALL + "/lineitem.parquet").limit(200)
    lines.union(lines.limit(50)).union(lines.limit(50)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
