"""WARC archives: a deterministic, sharded writer and a verifying reader.

Rows: (page_id, url, html). The payload of a row is the html in UTF-8; a null html is an empty payload.
Of records with equal payloads of at least `min_revisit` bytes, those with the largest page_id are
responses and the others are revisits that refer to it. A null page_id counts as smaller than any other; if all
are null, all are responses. Repeated rows with the largest page_id are all responses. A null url is
written as an empty target URI. An empty table gives an archive without files. Other columns are ignored.

Which shard a row goes to depends on the data alone: rows are in the order of (page_id, digest), and ranges of it are split at the widest bit in
which their rows differ, until each holds at most `shard_bytes` or equal keys alone; neighbours are then put together up to `shard_bytes`.
Beyond SHARDS * shard_bytes in all, shards grow instead of their number. A shard is one task, whose rows are sorted and streamed into
files that roll over at `roll_bytes` compressed bytes, one gzip member a record. A task writes under temporary
names and renames when a file is whole; the manifest, written by Spark's own commit protocol after that,
names the files that count. A retried or speculative task writes the same bytes under the same names. Temporary names
are deleted in the end."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tree, staged

#: Shards at most; bits by which the first round of splitting tells ranges apart, and later ones; bytes counted for a record's headers.
SHARDS, FIRST_BITS, BITS, HEADERS = 1 << 15, 10, 4, 512
RECORD_IDS = uuid.UUID("8d2f8a52-5f0c-4b43-9d0e-0b6f1f1d7c11")
MANIFEST = "file string, shard long, records long, file_bytes long, file_sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, record_id string"


class Ranges:
    """Ascending bounds of ranges of (page_id, digest); a digest counts by its first 64 bits, and a null page_id as the least number."""

    def __init__(self, bounds: list[int]):
        self.high = np.array([(b >> 64) - (1 << 63) for b in bounds], np.int64)
        self.low = np.array([b & MASK for b in bounds], np.uint64)

    def locate(self, pages: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The range that each key is in: the last one whose bound isn't above it."""
        first, last = np.searchsorted(self.high, pages, "left"), np.searchsorted(self.high, pages, "right")
        single = last - first == 1
        out = last.copy()
        out[single] = first[single] + (self.low[first[single]] <= digests[single])
        for at in np.unique(first[last - first > 1]).tolist():
            here = (first == at) & (last - first > 1)
            out[here] = at + np.searchsorted(self.low[at : int(last[here][0])], digests[here], "right")
        return out - 1


MASK = (1 << 64) - 1


def _keys(pages: pa.Array, digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pages.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.array([int(d[:16], 16) for d in digests.to_pylist()], np.uint64)


def _measured(heads: DataFrame, ranges: Ranges) -> list[tuple[int, int, int, int]]:
    """For each range with rows, in order: (its number, bytes, least key, greatest key)."""

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for part in parts:
            pages, digests = _keys(part.column(0), part.column(1))
            order = np.lexsort((digests, pages))
            at, n = ranges.locate(pages, digests)[order], part.column(2).to_numpy()[order]
            pages, digests = pages[order], digests[order]
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                least, most = ((int(pages[i]) + (1 << 63)) << 64 | int(digests[i]) for i in (lo, hi - 1))
                kept = found.setdefault(int(at[lo]), [0, least, most])
                kept[:] = kept[0] + int(n[lo:hi].sum()), min(kept[1], least), max(kept[2], most)
        text = lambda i: pa.array([f"{v[i]:032x}" for v in found.values()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), text(1), text(2)], ["at", "n", "least", "most"])

    parts = heads.select("page_id", "digest", "n").mapInArrow(measure, "at long, n long, least string, most string")
    return [(r.at, r.n, int(r.least, 16), int(r.most, 16)) for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()]


def shard_ranges(heads: DataFrame, shard_bytes: int) -> Ranges:
    """The ranges of the shards, from rows of (page_id, digest, n bytes).

    A round asks about the ranges that are still too large, in 2 ** BITS parts each: at most SHARDS * 2 ** BITS rows for the driver."""
    parts = [(n, least, most) for _, n, least, most in _measured(heads, Ranges([0]))]
    limit, bits = max(shard_bytes, sum(n for n, _, _ in parts) // SHARDS), FIRST_BITS
    while any(n > limit and least < most for n, least, most in parts):
        bounds, known = [], {}
        for n, least, most in parts:
            if n > limit and least < most:
                shift = max(0, (least ^ most).bit_length() - bits)
                bounds += [least, *(k << shift for k in range((least >> shift) + 1, (most >> shift) + 1))]
            else:
                known[len(bounds)] = (n, least, most)
                bounds.append(least)
        large = {at: (n, least, most) for at, n, least, most in _measured(heads, Ranges(bounds)) if at not in known}
        parts, bits = [part for _, part in sorted((known | large).items())], BITS
    shards, filled = [0], 0
    for n, least, _ in parts:
        if filled and filled + n > limit:
            shards.append(least)
            filled = 0
        filled += n
    return Ranges(shards)


def write_warc(pages: DataFrame, out: str, *, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20,
               min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the rows of pages to the folder `out` and return the manifest."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    heads = staged(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "heads")
    ranges = shard_ranges(heads.withColumn("n", F.col("size") + HEADERS), shard_bytes)

    @F.arrow_udf("int")
    def shard_of(page: pa.Array, digest: pa.Array) -> pa.Array:
        return pa.array(ranges.locate(*_keys(page, digest)).astype(np.int32))

    large = heads.filter(F.col("size") >= min_revisit).select("page_id", "digest", "url")
    groups = (
        large.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("digest").alias("d"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    )
    revisits = (
        large.join(groups, F.col("digest") == F.col("d"))
        .filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to", "refers_url").distinct()
    )
    # Both meet by page_id in the one shuffle that also sorts the payloads.
    nothing = lambda t: F.lit(None).cast(t)
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", nothing("long").alias("refers_to"), nothing("string").alias("refers_url")).unionByName(
        revisits.select("page_id", "digest", F.lit(0).alias("kind"), nothing("string").alias("url"), nothing("binary").alias("payload"), "refers_to", "refers_url")
    )
    dealt = both.withColumn("shard", shard_of("page_id", "digest")).repartitionById(len(ranges.high), F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(out, roll_bytes, date, level)
        for b in batches:
            writer.add(b.to_pydict())
        yield from writer.end()

    manifest = dealt.select("shard", "page_id", "kind", "digest", "url", "payload", "refers_to", "refers_url").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    drop_tree(spark, f"{out}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


class _Writer:
    """Files of the shards that one task holds."""

    def __init__(self, out: str, roll_bytes: int, date: str, level: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(out)
        self.roll, self.date, self.level = roll_bytes, date, level
        self.attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.shard, self.sink, self.done = None, None, []
        self.page, self.refers = None, {}
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def add(self, rows: dict) -> None:
        for shard, page, kind, digest, url, payload, to, to_url in zip(*(rows[c] for c in ("shard", "page_id", "kind", "digest", "url", "payload", "refers_to", "refers_url"))):
            if shard != self.shard:
                self.close()
                self.shard, self.seq, self.page, self.refers = shard, 0, None, {}
            if page != self.page:
                self.page, self.refers = page, {}
            if kind == 0:
                self.refers[digest] = (to, to_url)
                continue
            if self.sink is None:
                self.open()
            data = _record(page, url, payload, digest, self.refers.get(digest), self.date)
            z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            data = z.compress(data) + z.flush()
            self.sink.write(data)
            self.hash.update(data)
            self.size += len(data)
            self.records += 1
            if self.size >= self.roll:
                self.close()

    def open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.temp = f"{self.root}/_temporary/{self.attempt}-{self.name}"
        self.sink, self.hash, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        self.seq += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest()))
            self.sink = None

    def end(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.done:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.done), types)], ["file", "shard", "records", "file_bytes", "file_sha256"])


def _id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_IDS, f'{page}:{digest}')}>"


def _record(page, url: str, payload: bytes, digest: str, refers: tuple | None, date: str) -> bytes:
    """A whole record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_id(page, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers[0], digest)}",
                 f"WARC-Refers-To-Target-URI: {refers[1]}".replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers[0]}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            step = view[at : at + (1 << 16)]
            if not len(step):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers and block of a record; digests and lengths are recomputed, and a mismatch raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(h["content-length"])]
    if len(block) != int(h["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"wrong length in {h['warc-record-id']}")
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != h["warc-block-digest"]:
        raise ValueError(f"wrong block digest in {h['warc-record-id']}")
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest, n = h["warc-type"], h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"])
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"wrong payload in {h['warc-record-id']}")
    number = lambda x: int(x) if x else None
    return {"page_id": number(h["x-page-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number(h.get("x-refers-to-page-id")), "url": h["warc-target-uri"], "record_id": h["warc-record-id"], "payload": payload}


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files that the manifest in `out` names, checked as they are read."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("record_id", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for member in members(content.as_buffer()):
                    r = parse_record(member)
                    del r["payload"]
                    rows.append(r | {"file": name})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # The manifest has one short row a file, about 100 bytes for each shard_bytes of input.
    return files.join(manifest, "file", "left_semi").mapInArrow(read, RECORDS)
