"""What the operators share: staged tables in the cluster's shared folder, global ranks, tables by name."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Position bits of monotonically_increasing_id().
POSITION_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset and all runs in this one process (tests) a local folder is made and set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bytesmith-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/bytesmith-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost
    executors, and fixes anything that a second run could deal out differently."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tree(spark: SparkSession, path: str) -> None:
    """Delete a staged table or folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank_in_group") -> DataFrame:
    """df with the 0-based position of each row within its group, by `order`, without a window over whole groups.

    Rows are range-partitioned by (group, order), so a group of any size spreads over many tasks; each task
    numbers its own rows, and only one count per (partition, group) is accumulated. Equal rows get distinct ranks."""
    cols = [F.col(c) for c in [*group, *order]]
    where = F.monotonically_increasing_id()
    parts = staged(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_part", F.shiftright(where, POSITION_BITS).cast("int"))
        .withColumn("_pos", where.bitwiseAND((1 << POSITION_BITS) - 1)),
        "ranked",
    )
    counts = parts.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.col("p._part").eqNullSafe(F.col("o._part"))
    for c in group:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}"))
    return (
        parts.alias("p").join(offsets.alias("o"), on, "left")
        .select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("_pos") + F.col("_shift")).alias(rank))
    )
