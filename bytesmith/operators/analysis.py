"""Strings, entropy, value guesses and shape hints of byte regions: numpy over whole buffers, one pass an object."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_object

# strings

ENCODINGS = ("ascii", "utf16le", "utf16be")


def _printable(a: np.ndarray) -> np.ndarray:
    return (a >= 32) & (a <= 126)


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of true."""
    step = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())


def ascii_strings(data: bytes, least: int = 4) -> list[tuple[int, int, str, str]]:
    """(offset, bytes, encoding, text) of the runs of printable ASCII."""
    a = np.frombuffer(data, np.uint8)
    return [(s, e - s, "ascii", data[s:e].decode("ascii")) for s, e in _runs(_printable(a)) if e - s >= least]


def utf16_strings(data: bytes, least: int, big: bool) -> list[tuple[int, int, str, str]]:
    """Runs of printable characters with a zero byte each, at any alignment."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < 2:
        return []
    good = ((a[:-1] == 0) & _printable(a[1:])) if big else (_printable(a[:-1]) & (a[1:] == 0))
    found = []
    for parity in (0, 1):  # a pair can't begin inside another, so both alignments are islands of their own
        for s, e in _runs(np.ascontiguousarray(good[parity::2])):
            if e - s >= least:
                at, n = parity + 2 * s, 2 * (e - s)
                found.append((at, n, "utf16be" if big else "utf16le", data[at : at + n].decode("utf-16-be" if big else "utf-16-le")))
    return found


def find_strings(data: bytes, least: int = 4) -> list[tuple[int, int, str, str]]:
    """All three scans by offset, then encoding; a UTF-16 hit that is the other order's, one byte off and a character shorter, goes."""
    least = max(1, least)
    wide = utf16_strings(data, least, False) + utf16_strings(data, least, True)
    spans = {(o, n) for o, n, _, _ in wide}
    kept = [h for h in wide if (h[0] - 1, h[1] + 2) not in spans]
    return sorted(ascii_strings(data, least) + kept, key=lambda h: (h[0], ENCODINGS.index(h[2])))


def strings(objects: DataFrame, least: int = 4, content: str = "content") -> DataFrame:
    """object_id, ordinal, offset, size, encoding, text."""
    return per_object(objects, [content], lambda c: ((i, *h) for i, h in enumerate(find_strings(c or b"", least))), "object_id string, ordinal int, offset bigint, size bigint, encoding string, text string")


# entropy

def entropies(data: bytes, buckets: int) -> list[float]:
    """Shannon entropy over 8 bits of each of at most `buckets` equal parts; the last takes the remainder."""
    n = min(buckets, len(data))
    if n <= 0:
        return []
    a, w = np.frombuffer(data, np.uint8), len(data) // n
    part = np.minimum(np.arange(len(a)) // w, n - 1)
    counts = np.bincount(part * 256 + a, minlength=n * 256).reshape(n, 256)
    p = counts / counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = -np.where(p > 0, p * np.log2(p), 0.0).sum(axis=1)
    return (np.abs(bits) / 8).astype(np.float32).tolist()


def entropy(objects: DataFrame, buckets: int = 256, content: str = "content") -> DataFrame:
    """object_id, bucket, entropy (float, 0 to 1)."""
    return per_object(objects, [content], lambda c: enumerate(entropies(c or b"", buckets)), "object_id string, bucket int, entropy float")


def entropy_summary(buckets: DataFrame) -> DataFrame:
    """object_id, mean, peak, peak_bucket (the last on ties), packed (peak over 0.95)."""
    top = F.max(F.struct("entropy", "bucket"))
    return buckets.groupBy("object_id").agg(F.avg("entropy").alias("mean"), top.alias("t")).select("object_id", "mean", F.col("t.entropy").alias("peak"), F.col("t.bucket").alias("peak_bucket"), (F.col("t.entropy") > 0.95).alias("packed"))


def entropy_band(value):
    """low below 0.4, medium below 0.75, else high."""
    return F.when(value < 0.4, "low").when(value < 0.75, "medium").otherwise("high")


# guesses

#: Least and greatest seconds, the last for 64 bits, and the start of Windows file times.
UNIX = (1_000_000_000, 2**31 - 1, 4_102_444_800)
FILETIME = (10_000_000, 11_644_473_600)


def civil(seconds: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def dos_date(date: int, time: int) -> str | None:
    year, month, day = 1980 + (date >> 9), date >> 5 & 15, date & 31
    hour, minute, second = time >> 11, time >> 5 & 63, (time & 31) * 2
    if 1990 <= year <= 2040 and 1 <= month <= 12 and day >= 1 and hour < 24 and minute < 60 and second <= 58:
        return f"{year:04}-{month:02}-{day:02} {hour:02}:{minute:02}:{second:02}"
    return None


def guesses(data: bytes) -> list[tuple[str, str]]:
    """(label, detail) of what the bytes may be, in a fixed order."""
    out = []
    run = next((i for i, b in enumerate(data) if not 32 <= b <= 126), len(data))
    if run >= 4:
        out.append(("ascii", data[:run].decode("ascii")))
    if len(data) >= 4:
        for order in ("little", "big"):
            v = int.from_bytes(data[:4], order)
            if UNIX[0] <= v <= UNIX[1]:
                out.append((f"unix seconds u32 {order}", civil(v)))
        if when := dos_date(int.from_bytes(data[2:4], "little"), int.from_bytes(data[:2], "little")):
            out.append(("dos date", when))
    if len(data) >= 8:
        for order in ("little", "big"):
            v = int.from_bytes(data[:8], order)
            for unit, seconds in (("unix seconds", v), ("unix milliseconds", v // 1000), ("windows filetime", v // FILETIME[0] - FILETIME[1])):
                if UNIX[0] <= seconds <= UNIX[2]:
                    out.append((f"{unit} u64 {order}", civil(seconds)))
    if len(data) >= 16 and 1 <= data[6] >> 4 <= 5:
        out.append((f"uuid v{data[6] >> 4}", str(uuid.UUID(bytes=data[:16]))))
    return out


def guess(objects: DataFrame, offset: int = 0, most: int = 16, content: str = "content") -> DataFrame:
    """object_id, ordinal, label, detail for the `most` bytes at offset."""
    return per_object(objects, [content], lambda c: ((i, *g) for i, g in enumerate(guesses((c or b"")[offset : offset + most]))), "object_id string, ordinal int, label string, detail string")


# hints

SAMPLE, STRIDES = 32 * 1024, 256


def _fill(a: np.ndarray) -> list[tuple]:
    return [("fill", f"{len(a)} bytes of {a[0]:#04x}", 0, len(a))] if len(a) >= 8 and (a == a[0]).all() else []


def _size_prefix(data: bytes, base: int, total: int) -> list[tuple]:
    for width in (4, 2):
        for order in ("little", "big"):
            if len(data) >= width:
                v = int.from_bytes(data[:width], order)
                for what, n in (("rest of the region", len(data) - width), ("rest of the file", total - base - width), ("whole file", total)):
                    if v == n:
                        return [("size prefix", f"u{width * 8} {order}: {v}, the {what}", 0, width)]
    return []


def _offset_table(data: bytes, total: int) -> list[tuple]:
    for order, code in (("little", "<u4"), ("big", ">u4")):
        v = np.frombuffer(data[: len(data) // 4 * 4], code).astype(np.int64)
        if len(v) < 4:
            return []
        inside = v <= total
        link = inside[1:] & inside[:-1] & (v[1:] > v[:-1])
        best = max(((e - s + 1, -s) for s, e in _runs(link)), default=(0, 0))
        if best[0] >= 4:
            return [("offset table", f"{best[0]} rising u32 {order}", -best[1] * 4, best[0] * 4)]
    return []


def _string_pool(data: bytes) -> list[tuple]:
    a = np.frombuffer(data, np.uint8)
    good = [(s, e) for s, e in _runs(_printable(a)) if e - s >= 4 and e < len(a) and a[e] == 0]
    covered = sum(e - s + 1 for s, e in good)
    if len(good) >= 3 and covered * 2 >= len(a):
        return [("string pool", f"{len(good)} strings over {covered * 100 // len(a)}%", 0, len(a))]
    return []


def _records(data: bytes) -> list[tuple]:
    a = np.frombuffer(data[:SAMPLE], np.uint8)
    if len(a) < 32 or len(np.unique(a)) < 4:
        return []
    p = (np.bincount(a, minlength=256) / len(a)).astype(np.float32)
    chance = np.float32((p * p).sum())
    strides = range(2, min(STRIDES, len(a) // 4) + 1)
    score = np.array([np.float32(np.count_nonzero(a[s:] == a[:-s])) / np.float32(len(a) - s) for s in strides], np.float32)
    best = float(score.max(initial=0))
    if best < 0.35 or best - chance < 0.15:
        return []
    stride = next(s for s, x in zip(strides, score) if x - chance >= np.float32(0.95) * (np.float32(best) - chance))
    return [("records", f"{len(a) // stride} of {stride} bytes", 0, len(data))]


def hints(data: bytes, base: int = 0, total: int | None = None) -> list[tuple[str, str, int, int]]:
    """(label, detail, offset, size) of shapes a region shows; a fill has no other."""
    total = len(data) if total is None else total
    if not data:
        return []
    found = _fill(np.frombuffer(data, np.uint8)) or [*_size_prefix(data, base, total), *_offset_table(data, total), *_string_pool(data), *_records(data)]
    return [(label, detail, base + at, n) for label, detail, at, n in found]


def shape_hints(objects: DataFrame, offset: int = 0, most: int = 1 << 20, content: str = "content") -> DataFrame:
    """object_id, ordinal, label, detail, offset, size for the region at offset."""
    make = lambda c: ((i, *h) for i, h in enumerate(hints((c or b"")[offset : offset + most], offset, len(c or b""))))
    return per_object(objects, [content], make, "object_id string, ordinal int, label string, detail string, offset bigint, size bigint")


def limited(rows: DataFrame, most: int, order: list) -> DataFrame:
    """The first `most` rows of each object, with the exact count and whether some were cut."""
    n = F.count(F.lit(1)).over(Window.partitionBy("object_id"))
    at = F.row_number().over(Window.partitionBy("object_id").orderBy(*order))
    return rows.withColumn("total_rows", n).withColumn("_at", at).filter(F.col("_at") <= most).drop("_at").withColumn("truncated", F.col("total_rows") > most)
