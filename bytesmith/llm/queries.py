"""The operators' queries over the given tables, with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pii, secrets
from .common import new_path, table
from .forest import nearest
from .neardup import classes
from .packing import pack
from .quality import classify
from .sharding import shard_documents
from .topk import top_k
from .warc import read_warc, write_warc


#: The key of the queries' surrogates; a real run takes its own.
PII_KEY = "bytesmith"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return whole.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    everything = F.array_sort(F.concat("base_spans", "entropy_spans"))
    return found.withColumn("every", everything).select(
        "doc_id", *[count(k).alias(f"n_{kind.name}") for k, kind in enumerate(secrets.BASE)],
        F.sha2(secrets.span_text("base_spans"), 256).alias("base_sha256"), secrets.span_text("every").alias("spans"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24, 8)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _every_hundredth(rows: DataFrame) -> DataFrame:
    """The contract's query set: rows whose id is divisible by 100."""
    return rows.filter(F.col("vec_id") % 100 == 0)


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, _every_hundredth(rows), 10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, _every_hundredth(rows), 10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_forest": op6_forest,
    "op7_quality": op7_quality,
    "op8_topk": op8_topk,
    "op9_warc": op9_warc,
    "op10_neardup": op10_neardup,
}

SQL = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM m""",
}
