"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are those of the tokenizer as its file has it, with add_special_tokens=False, then `end`: the strings of added
tokens (<|endoftext|>) that stand in a text are those tokens' ids, and none are added. A null or empty text has the one id
`end`. Repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
Cuts depend on a document's length alone: whole windows of `capacity` ids first, each a sequence of its own without
padding, then the rest in near-equal pieces of at most `piece` ids. The rests are dealt into blocks of about
`block_docs` documents by a hash of the staged row. In a block, differencing starts from one partial partition an item,
over m windows, and always merges the two with the greatest imbalance, fullest slots onto emptiest; m
begins at the least count that can hold the block and rises while any window exceeds the capacity.
Blocks are bounded whatever the data, and nothing is gathered beyond a block.

The tokenizer's files are slow to apply to running text, so distinct words are encoded once and kept for later batches.
Words are cut at ASCII white space, which the tokenizer drops and never joins over; ASCII letters are lowered first, as
the tokenizer itself does, so ids are the same as those of whole texts (tests compare both)."""

from __future__ import annotations

import heapq
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder(dict):
    """Ids of texts by way of their distinct words; `most` bounds the words that are kept.

    Words of Latin letters are split, lowered and merged here, with the same ranks on tiktoken's merge loop, where byte 0xFF,
    which UTF-8 never uses, stands for the end of a word; all other words go to the tokenizer."""

    END_OF_WORD = "</w>"
    #: The pre-tokenizer's pattern, as its file has it.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 600_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__()
        self.most = most
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # The tokenizer looks for these first, in the text as it is; what lies between is encoded by itself.
        self.added = {t: struct.pack("<I", i) for t, i in special.items()}
        self.tokenizer.encode_special_tokens = True  # words are lowered here, which must not make such a string of <|ENDOFTEXT|>
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if token not in special:
                stem = token.removesuffix(self.END_OF_WORD)
                ranks[bytes(byte_of[c] for c in stem) + b"\xff" * (stem != token)] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split, self.plain = regex.compile(self.PATTERN).findall, regex.compile(r"[\x21-\x7e\u00a1-\u00ac\u00ae-\u024f]*").fullmatch

    def ids(self, word: str) -> list[int]:
        low = word.lower()
        if low.isalpha() and max(word) < "\u0250":
            return self.merge(low.encode() + b"\xff")
        if not self.plain(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out = []
        for part in self.split(low):
            out += self.merge(part.encode() + b"\xff")
        return out

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = array("I", self.ids(word.decode())).tobytes()
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.cut is not None and self.cut.search(text):
            between, found = self.cut.split(text), self.cut.findall(text)
            return b"".join(self._words(x) + self.added.get(t, b"") for x, t in zip(between, [*found, ""]))
        return self._words(text)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def byte_symbols() -> str:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(other)) for b in range(256))


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where the pieces of a document of n ids begin, and n."""
    whole = n // capacity
    at = [i * capacity for i in range(whole + 1)]
    rest = n - whole * capacity
    parts = -(-rest // piece)
    return at + [at[-1] + rest * (i + 1) // parts for i in range(parts)]


def pieces_of(docs: DataFrame, path: str, end: int, capacity: int, piece: int) -> DataFrame:
    """A row per piece, with the checksum of its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordEncoder(path), struct.pack("<I", end)
        for b in batches:
            out = []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = encoder.encode(text.as_py()) + last
                n = len(ids) // 4
                where = cuts(n, capacity, piece)
                out += [(doc, row, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), n) for a, z in zip(where, where[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(encode, PIECES)


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over m windows: the window of each item, and the windows' sums."""
    if m == 1:
        return np.zeros(len(sizes), np.int64), np.array([sizes.sum()])
    slots = np.int32 if m > 30_000 else np.int16
    sums, merged, heap = {}, [], []
    for i, s in enumerate(sizes.tolist()):
        sums[i] = np.zeros(m, np.int64)
        sums[i][-1] = s  # ascending
        heap.append((-s, i))
    heapq.heapify(heap)
    node = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable").astype(slots)
        sums[node] = both[order]
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(sums[node][-1] - sums[node][0]), node))
        node += 1
    windows: dict[int, np.ndarray] = {heap[0][1]: np.arange(m)}
    result = np.zeros(len(sizes), np.int64)
    for top in range(node - 1, len(sizes) - 1, -1):
        a, b, order = merged.pop()
        of = np.empty(m, np.int64)
        of[order] = windows.pop(top)
        for child, w in ((a, of), (b, of[::-1])):
            if child < len(sizes):
                result[child] = w[-1]
            else:
                windows[child] = w
    return result, sums[heap[0][1]]


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; the count rises until every window holds at most the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where, sums = difference(sizes, m)
        if sums.max() <= capacity:
            return where
        m += max(1, m // 200)


def pack(docs: DataFrame, path: str, *, end: int = 1, capacity: int = 2048, piece: int = 512, block_docs: int = 512) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    parts = staged(pieces_of(docs, path, end, capacity, piece), "pieces")
    n_docs = parts.filter("length < %d and start + length = doc_tokens" % capacity).count()
    blocks = max(1, -(-n_docs // block_docs))
    whole = parts.filter(F.col("length") == capacity)
    rest = parts.filter(F.col("length") < capacity).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "start"], kind="stable")
        where = pack_block(rows.length.to_numpy(), capacity)
        rows = rows.iloc[np.argsort(where, kind="stable")].assign(window=np.sort(where, kind="stable"))
        rows["offset"] = rows.groupby("window").length.cumsum() - rows.length
        rows["sequence_id"] = rows.block * SEQUENCES + rows.window * 2 + 1  # odd; whole windows get even numbers
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.groupBy("block").applyInPandas(block, columns)
    alone = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


#: Numbers set aside for a block's sequences.
SEQUENCES = 1 << 24
