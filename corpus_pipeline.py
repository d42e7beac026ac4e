"""The corpus pipeline: classify, deduplicate, replace personal data, pack.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of `documents`. Rows with null or empty texts go in the first stage, which finds no words in them; the other
stages define such rows too, and empty tables go through all stages. Repeated rows, null ids and ties are kept by the first stage, of equal texts one
row stays in the second, with the least id. Extra columns pass through all stages but the last, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesmith.llm import neardup, packing, pii, quality
from bytesmith.llm.common import new_path, table

PII_KEY = "bytesmith"
#: No stage can be written in SQL: a fitted classifier, sampled sketches, keyed surrogates, a tokenizer.
ORACLE_SQL = None


def _beside(docs: DataFrame, *without: str) -> Column:
    """The columns of docs as one, so that none of them can clash with an operator's results."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("document")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    known = quality.classify(docs.select(_beside(docs), "doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"), carry=["document"])
    return known.filter("keep").select("document.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return neardup.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with surrogates for personal data; n_chars is that of the new text."""
    new = pii.pseudonymise(docs.select(_beside(docs, "text"), "text"), PII_KEY)
    chars = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars"))
    given = {"text": F.col("text"), "n_chars": chars.alias("n_chars")}
    return new.select(*[given.get(c, F.col(f"document.`{c}`")) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they are packed into."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("classify", classify), ("deduplicate", deduplicate), ("replace_personal_data", replace_personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
