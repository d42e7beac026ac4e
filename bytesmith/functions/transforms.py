"""Reversible byte transforms of the layout language's decode clause."""

from __future__ import annotations

import binascii
import zlib

import numpy as np


class TransformError(ValueError):
    pass


def _xor(data: bytes, *key: int) -> bytes:
    k = np.array([b & 255 for b in key], np.uint8)
    a = np.frombuffer(data, np.uint8)
    return (a ^ np.resize(k, len(a))).tobytes() if len(a) else b""


def _rolling_xor(data: bytes, seed: int, mul: int, add: int) -> bytes:
    stream, k = [], seed & 255
    for _ in range(min(len(data), 256 * 2)):
        stream.append(k)
        k = (k * mul + add) & 255
    if len(data) > len(stream):  # the stream's states number 256, so it has come round by now
        at, seen = 0, {}
        while stream[at] not in seen:
            seen[stream[at]] = at
            at += 1
        start = seen[stream[at]]
        period = stream[start:at]
        tail = np.resize(np.array(period, np.uint8), len(data) - start)
        whole = np.concatenate([np.array(stream[:start], np.uint8), tail])
    else:
        whole = np.array(stream, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ whole).tobytes() if data else b""


def _add(data: bytes, n: int) -> bytes:
    return (np.frombuffer(data, np.uint8) + np.uint8(n & 255)).tobytes()


_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_IGNORED = b"= \t\r\n\x0b\x0c"


def _base64(data: bytes) -> bytes:
    """'=' and white space are skipped wherever they are; bits left over at the end are dropped."""
    solid = data.translate(None, _IGNORED)
    if odd := solid.translate(None, _SYMBOLS):
        raise TransformError(f"byte {odd[0]:#04x} is not base64")
    # Whole groups of four, then what two or three symbols more hold; a single one holds no byte.
    rest = len(solid) % 4
    return binascii.a2b_base64(solid[: len(solid) - (rest == 1)] + b"A" * (4 - rest if rest > 1 else 0))[: len(solid) * 6 // 8]


def _inflater(window: int):
    def run(data: bytes) -> bytes:
        """The first stream alone; what follows it is ignored. A stream cut short is an error."""
        z = zlib.decompressobj(window)
        try:
            out = z.decompress(data)
        except zlib.error as e:
            raise TransformError(f"compressed data are broken: {e}") from None
        if not z.eof:
            raise TransformError("compressed data end early")
        return out

    return run


_RUN = {"xor": _xor, "rolling_xor": _rolling_xor, "add": _add, "base64": _base64, "zlib_inflate": _inflater(15), "inflate": _inflater(-15), "gunzip": _inflater(31)}


def apply_transform(name: str, args: tuple[int, ...], data: bytes) -> bytes:
    return _RUN[name](data, *args)
