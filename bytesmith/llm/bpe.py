"""Byte-level BPE: encoding of whole texts by overlapping chunks, and decoding.

Texts of at most `chunk` characters are encoded where they lie. Longer ones are cut into chunks that overlap by
`overlap` characters, dealt over the cluster, and pre-tokenised in parallel. Where a chunk's pre-token boundaries and its left
neighbour's have one in common inside the overlap, both agree from there on: that is where they
are stitched. A stitch is taken only before an ASCII blank after another character, since the pattern then also gives the same
matches to either side of it alone. Chunks without such a boundary (a run without blanks longer than the overlap) are joined to
their neighbour and looked at again, until all stitches hold. Then each piece is encoded by itself; ids are joined in order.
Decoding concatenates the tokens' bytes, so it is exact even where a token ends inside a character.

A null or empty text has no ids and decodes to no bytes. Rows are kept apart even if they repeat, ids are null or tie.
An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CHUNKS = "row long, doc_id long, chunk long, start long, text string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def _id_lists(doc_ids: pa.Array, found: list[list[int]], extra: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
    flat = np.empty(ends[-1], np.int32)
    for a, z, ids in zip(ends, ends[1:], found):
        flat[a:z] = ids
    return pa.RecordBatch.from_arrays([doc_ids, *extra, pa.ListArray.from_arrays(ends.astype(np.int32), flat)], ["doc_id", *names, "ids"])


def cut_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text; one pass over a text, whatever its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                for lo in range(0, len(text), 64 * chunk):  # a batch holds 64 chunks at most
                    rows = [(row, doc, at // chunk, at, text[at : at + chunk + overlap]) for at in range(lo, min(len(text), lo + 64 * chunk), chunk)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], ["row", "doc_id", "chunk", "start", "text"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, CHUNKS)


def boundaries(text: str, finditer) -> np.ndarray:
    """Where pre-tokens begin before an ASCII blank and after another character; the last pre-token may be cut, its beginning not."""
    return np.array([m.start() for m in finditer(text) if m.start() and text[m.start()] in " \n" and not text[m.start() - 1].isspace()], np.int64)


def stitch(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Pieces (row, doc_id, piece, text) that make up the texts and can be encoded by themselves."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        finditer = regex.compile(pattern).finditer
        for b in batches:
            heads, tails = [], []
            for start, text in zip(b.column("start").to_pylist(), b.column("text").to_pylist()):
                at = boundaries(text, finditer)
                heads.append((start + at[at <= overlap]).tolist())
                tails.append((start + at[at >= len(text) - overlap]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*b.schema.names, "head", "tail"])

    by_row = Window.partitionBy("row").orderBy("chunk")
    while True:
        seen = chunks.mapInArrow(look, f"{CHUNKS}, head array<long>, tail array<long>")
        met = staged(
            seen.withColumn("sync", F.when(F.row_number().over(by_row) == 1, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_row))))).drop("head", "tail"),
            "stitches",
        )
        if met.filter("sync IS NULL").isEmpty():
            break
        # A chunk that doesn't meet its neighbour is joined to it: the neighbour's text up to where its own begins, then that.
        runs = met.withColumn("run", F.sum(F.col("sync").isNotNull().cast("long")).over(by_row)).withColumn("next", F.lead("start").over(by_row))
        last = F.col("chunk") == F.max("chunk").over(Window.partitionBy("row", "run"))
        own = F.when(last, F.col("text")).otherwise(F.expr("left(text, int(next - start))"))
        joined = runs.withColumn("own", own).groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("chunk").alias("chunk"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("chunk", "own"))).alias("parts"))
        chunks = joined.select("row", "doc_id", "chunk", "start", F.array_join("parts.own", "").alias("text"))
    begin = F.col("sync") - F.col("start")
    upto = F.coalesce(F.lead("sync").over(by_row), F.col("start") + F.length("text")) - F.col("start")
    return met.withColumn("begin", begin).withColumn("upto", upto).select("row", "doc_id", F.col("chunk").alias("piece"), F.expr("substring(text, int(begin + 1), int(upto - begin))").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, *, chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """doc_id, ids: a row per document."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern).encode_ordinary
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield _id_lists(part.column(0), [enc(x.as_py()) if x.is_valid else [] for x in part.column(1)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern).encode_ordinary
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                part = b.slice(lo, 32)
                yield _id_lists(part.column(1), [enc(x.as_py()) for x in part.column(3)], [part.column(0), part.column(2)], ["row", "piece"])

    long_text = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.filter(~long_text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(alone, "doc_id long, ids array<int>")
    long = docs.filter(long_text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = staged(cut_chunks(long, chunk, overlap), "chunks")
    if cut.isEmpty():
        return short
    parts = stitch(cut.repartition("row", "chunk"), pattern, overlap).select("row", "doc_id", "piece", "text").repartition("row", "piece").mapInArrow(pieces, "doc_id long, row long, piece long, ids array<int>")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` and `data`, the concatenated bytes of its `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        for b in batches:
            at = b.schema.get_field_index("ids")
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column(at)
                offsets = np.asarray(lists.offsets)
                ids = np.asarray(lists.values)[offsets[0] : offsets[-1]]
                n = size[ids]
                upto = np.concatenate([[0], np.cumsum(n)])
                data = pool[np.arange(upto[-1]) + np.repeat(begin[ids] - upto[:-1], n)]
                ends = upto[offsets - offsets[0]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])], [*b.schema.names, "data"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in encoded.dtypes)}, data binary")
