"""Sources and sinks of binary objects: files, columns, pages and heads; edited bytes back to files."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE, ROW = 4096, 16


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: in spark.checkpoint.dir, or where all runs in this one process a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bytesmith-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/bytesmith-{spark.sparkContext.applicationId}"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores where a table comes in fewer partitions than these, as a small file of one row group does; larger ones stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """object_id (the path), content, length of each file; length and path filters reach the source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select(F.col("path").alias("object_id"), "content", "length")


def column(df: DataFrame, object_id: str | Column, content: str | Column) -> DataFrame:
    """Objects from any table: a binary column as it is, a string in UTF-8."""
    id_col, data = (F.col(c) if isinstance(c, str) else c for c in (object_id, content))
    kind = df.select(data).schema[0].dataType.simpleString()
    return df.select(id_col.cast("string").alias("object_id"), (data if kind == "binary" else F.encode(data, "UTF-8")).alias("content"))


def region(objects: DataFrame, at: int = 0, size: int | None = None) -> DataFrame:
    """Objects cut to a region, clamped to what there is."""
    total = F.octet_length("content")
    start = F.least(F.lit(at), total)
    n = total - start if size is None else F.least(F.lit(size), total - start)
    return objects.withColumn("content", F.substring("content", start + 1, n))


def pages(objects: DataFrame, page: int = PAGE) -> DataFrame:
    """object_id, page, offset, content: the object in pages, the last one short; an empty object has none."""
    n = F.ceil(F.octet_length("content") / page)
    return (
        objects.filter(F.octet_length("content") > 0).withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .select("object_id", "page", (F.col("page") * page).alias("offset"), F.substring(F.col("content"), (F.col("page") * page + 1).cast("int"), F.lit(page)).alias("content"))
    )


def hex_rows(page_rows: DataFrame, row: int = ROW) -> DataFrame:
    """object_id, offset, hex, ascii: the rows of a hex view."""
    rows = pages(page_rows.select(F.struct("object_id", F.col("offset").alias("base")).alias("object_id"), "content"), row)
    printable = F.regexp_replace(F.decode(F.col("content"), "ISO-8859-1"), "[^ -~]", ".")
    return rows.select(F.col("object_id.object_id").alias("object_id"), (F.col("object_id.base") + F.col("offset")).alias("offset"), F.trim(F.regexp_replace(F.hex("content"), "(..)", "$1 ")).alias("hex"), printable.alias("ascii"))


def heads(spark: SparkSession, path: str, most: int = 512) -> DataFrame:
    """object_id, content (the first bytes), length: reads no more of a file than that.

    Works on any store that pyarrow opens; the list of files comes from Spark without their content."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    out.append(f.read(most))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(1)], ["object_id", "content", "length"])

    return listed.mapInArrow(read, "object_id string, content binary, length bigint")


def save(objects: DataFrame, folder: str, *, backup: bool = True) -> DataFrame:
    """Write each object (object_id: a file's name) under `folder`; returns what was written: object_id, bytes, backed_up.

    A file is written under a temporary name and renamed; with `backup`, one that is there already is kept as .bak."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                name = key.rsplit("/", 1)[-1]
                if name in ("", ".", ".."):
                    raise ValueError(f"{key!r} is no file name")
                target, data = f"{root}/{name}", content.as_py() or b""
                temp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(temp, compression=None) as f:
                    f.write(data)
                there = store.get_file_info(target).type == fs.FileType.File
                if there and backup:
                    store.copy_file(target, f"{target}.bak")
                store.move(temp, target)
                rows.append((key, len(data), there and backup))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], ["object_id", "bytes", "backed_up"])

    return objects.select(F.col("object_id").cast("string").alias("object_id"), "content").mapInArrow(write, "object_id string, bytes bigint, backed_up boolean")
