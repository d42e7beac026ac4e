"""Hashed word shingles of texts, in numpy over the bytes of Arrow columns.

Words are runs of ASCII letters and digits and of all bytes above 127, in lower-cased text. A shingle is five words in a row; a text of
one to four words has one shingle, of all its words. A text without words has none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Random odd numbers of the hash functions: of the powers of a byte's place, of each word of a shingle, of the mixers.
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bits of a shingle's hash, and of a text's number within a batch.
HASH_BITS, BATCH_BITS = 44, 20
BATCH_BYTES = 1 << 20

_word_byte = np.zeros(256, bool)
_word_byte[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_forward, _backward = _powers(_BASE, 2 * BATCH_BYTES), _powers(pow(_BASE, -1, 1 << 64), 2 * BATCH_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of less than 2 * BATCH_BYTES bytes, and where they begin."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _word_byte[data]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _forward[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * _backward[begin]), begin


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of bytes: long ones are cut between words, and a word of over BATCH_BYTES at that length."""
    if len(data) < 2 * BATCH_BYTES:
        return _words(data)
    parts, at = [], 0
    while at < len(data):
        upto = min(len(data), at + BATCH_BYTES)
        if upto < len(data):
            gaps = np.flatnonzero(~_word_byte[data[at:upto]])
            upto = at + int(gaps[-1]) + 1 if len(gaps) else upto
        hashes, begin = _words(data[at:upto])
        parts.append((hashes, begin + at))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*parts))


def batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about BATCH_BYTES in all; a longer text is alone."""
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, "right")) - 1)
        hi = min(hi, n, lo + (1 << BATCH_BITS) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: (text's number, hash, how often), by text, then hash."""
    # A blank between texts keeps the last word of one from the first of the next.
    sizes = np.diff(offsets)
    shifted = offsets[:-1] + np.arange(len(sizes))
    spaced = np.full(len(data) + len(sizes), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    hashes, begin = words(spaced)
    owner = np.searchsorted(shifted, begin, "right") - 1
    n = len(hashes)
    whole = np.flatnonzero(owner[: n - WORDS + 1] == owner[WORDS - 1 :]) if n >= WORDS else np.zeros(0, np.int64)
    value = np.zeros(len(whole), np.uint64)
    for i in range(WORDS):
        value += hashes[whole + i] * _PLACES[i]
    of = owner[whole]
    counts = np.bincount(owner, minlength=len(sizes))
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        first = np.searchsorted(owner, few)
        short = np.array([int(sum(int(hashes[f + i]) * int(_PLACES[i]) for i in range(counts[t])) + int(counts[t])) & (2**64 - 1) for t, f in zip(few, first)], np.uint64)
        value, of = np.concatenate([value, short]), np.concatenate([of, few])
    key = np.sort((of.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(value) >> np.uint64(64 - HASH_BITS)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    often = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), often
