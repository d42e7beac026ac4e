"""Checksums of whole objects, and of the spans that a schema checks."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import checksum
from .common import per_object


def fast_checksum(name: str, data: bytes) -> int:
    """checksum() with numpy for the sums of long objects."""
    a = np.frombuffer(data, np.uint8)
    if name.startswith("sum"):
        return int(a.sum(dtype=np.uint64)) % (1 << int(name[3:]))
    if name == "xor8":
        return int(np.bitwise_xor.reduce(a)) if len(a) else 0
    return {"crc32": zlib.crc32, "adler32": zlib.adler32}[name](data) if name in ("crc32", "adler32") else checksum(name, data)


def checksums(objects: DataFrame, names: tuple[str, ...], content: str = "content") -> DataFrame:
    """object_id and a bigint column per checksum."""
    return per_object(objects, [content], lambda c: (tuple(fast_checksum(n, c or b"") for n in names),), "object_id string, " + ", ".join(f"{n} bigint" for n in names))


def verdicts(fields: DataFrame) -> DataFrame:
    """object_id, path, algo, computed, stored, ok of the checked fields."""
    return fields.filter("check IS NOT NULL").select("object_id", "path", "check.algo", "check.computed", "check.stored", "check.ok")


def failed(fields: DataFrame) -> DataFrame:
    """object_id, failed: the number of checks that don't match."""
    return fields.groupBy("object_id").agg(F.count_if(F.col("check.ok") == F.lit(False)).alias("failed"))
