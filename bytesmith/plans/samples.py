"""Small files of the built-in formats, made from a number and a name, to run the layouts over."""

from __future__ import annotations

import gzip
import io
import sqlite3
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def png(k: int, name: str) -> bytes:
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    header = struct.pack(">IIBBBBB", 100 + k, k + 1, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", name.encode()) + chunk(b"IEND", b"") + b"after the end"


def gzipped(k: int, name: str) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(name, "wb", mtime=1_000_000_000 + k, fileobj=out) as z:
        z.write(name.encode())
    return out.getvalue()


def zipped(k: int, name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(k % 3 + 1):
            z.writestr(f"{name}-{i}", name)
    return out.getvalue()


def elf(k: int, name: str) -> bytes:
    head = b"\x7fELF\x02\x01\x01\0" + bytes(8) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 4096 * k, 64, 120, 0, 64, 56, 1, 64, 1, 0)
    return head + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, len(name), 0, 0) + struct.pack("<IIQQQQIIQQ", 0, 1, 6, 0, 0, k, 0, 0, 0, 0)


def pe(k: int, name: str) -> bytes:
    optional = struct.pack("<HBBIIIIII", 0x10B, 1, 2, k + 3, 4, 5, 6, 7, 8) + struct.pack("<I", 4096 * k)
    optional += struct.pack("<IIHHHHHHIIIIHH", 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 3, 0) + struct.pack("<IIIIII", 1, 1, 1, 1, 0, 1) + bytes(8)
    section = name.encode()[:8].ljust(8, b"\0") + struct.pack("<IIIIIIHHI", 1, 2, 3, 4, 0, 0, 0, 0, 1 << 29)
    gap = bytes(k)  # the headers' place is read from the stub
    return b"MZ" + bytes(58) + struct.pack("<I", 64 + k) + gap + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 2) + optional + section


def macho(k: int, name: str) -> bytes:
    return struct.pack("<8I", 0xFEEDFACF, 0x0100000C, 0, 2, k, len(name), 0, 0)


def pcap(k: int, name: str) -> bytes:
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, -k, 0, 65535, 1)
    return head + b"".join(struct.pack("<IIII", i, 2, len(name), 60) + name.encode() for i in range(k % 4 + 1))


def sqlite(k: int, name: str) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("PRAGMA page_size = 1024")
    db.execute(f"PRAGMA user_version = {k}")
    db.execute("CREATE TABLE t (x)")
    db.commit()
    return db.serialize()


def wasm(k: int, name: str) -> bytes:
    section = lambda i, b: bytes([i, len(b)]) + b
    export = b"\x01" + bytes([len(name)]) + name.encode() + b"\x00" + bytes([k % 128])
    return b"\0asm\x01\0\0\0" + section(1, b"\x01\x60\x02\x7f\x7f\x01\x7f") + section(3, b"\x01\x00") + section(7, export) + section(10, b"\x01\x07\x00\x20\x00\x20\x01\x6a\x0b")


def wasm_packed(k: int, name: str) -> bytes:
    return gzip.compress(wasm(k, name))


def gif(k: int, name: str) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 300 + k, 200 + k, 0b10110101, k, 0)


def sample(make, number: Column, name: Column) -> Column:
    """BINARY: make(number, name) of each row."""

    @F.arrow_udf("binary")
    def run(numbers: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([make(k, n) for k, n in zip(numbers.to_pylist(), names.to_pylist())], pa.binary())

    return run(number.cast("int"), name)
