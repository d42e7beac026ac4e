"""Checksums: plain functions over bytes, and Column builders where Spark can compute them itself."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(poly: int, reflected: bool) -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte if reflected else byte << 8
        for _ in range(8):
            if reflected:
                c = (c >> 1) ^ poly if c & 1 else c >> 1
            else:
                c = ((c << 1) ^ poly if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return tuple(out)


#: Polynomial, reflected, start.
CRC16 = {"crc16": (0xA001, True, 0), "crc16_modbus": (0xA001, True, 0xFFFF), "crc16_ccitt": (0x1021, False, 0xFFFF), "crc16_xmodem": (0x1021, False, 0)}
_TABLES = {(poly, reflected): _table(poly, reflected) for poly, reflected, _ in CRC16.values()}


def _crc16(name: str, data: bytes) -> int:
    poly, reflected, c = CRC16[name]
    table = _TABLES[poly, reflected]
    if reflected:
        for b in data:
            c = (c >> 8) ^ table[(c ^ b) & 255]
    else:
        for b in data:
            c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


def _xor8(data: bytes) -> int:
    out = 0
    for b in data:
        out ^= b
    return out


def checksum(name: str, data: bytes) -> int:
    """The checksum of `data` by its name in the layout language."""
    if name in CRC16:
        return _crc16(name, data)
    if name.startswith("sum"):
        return sum(data) % (1 << int(name[3:]))
    return {"crc32": zlib.crc32, "adler32": zlib.adler32, "xor8": _xor8}[name](data)


def byte_values(data: Column) -> Column:
    """array<int> of the bytes of a binary column."""
    hexed = F.hex(data)
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def _bytes_or_none(data: Column) -> Column:
    return F.when(F.octet_length(data) > 0, byte_values(data)).otherwise(F.array().cast("array<int>"))


def checksum_column(name: str, data: Column) -> Column:
    """bigint; JVM expressions only, for short spans and those that Spark has built in."""
    values = _bytes_or_none(data)
    zero = F.lit(0).cast("bigint")
    if name == "crc32":
        return F.crc32(data).cast("bigint")
    if name.startswith("sum"):
        return F.aggregate(values, zero, lambda a, b: a + b) % (1 << int(name[3:]))
    if name == "xor8":
        return F.aggregate(values, zero, lambda a, b: a.bitwiseXOR(b.cast("bigint")))
    if name == "adler32":
        start = F.struct(F.lit(1).cast("bigint").alias("a"), zero.alias("b"))
        return F.aggregate(values, start, lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")), lambda s: s["b"] * 65536 + s["a"])
    poly, reflected, first = CRC16[name]
    table = F.array(*[F.lit(v).cast("bigint") for v in _TABLES[poly, reflected]])
    if reflected:
        step = lambda c, b: F.shiftright(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(b.cast("bigint")).bitwiseAND(255).cast("int")))
    else:
        step = lambda c, b: (F.shiftleft(c, 8).bitwiseAND(F.lit(0xFFFF).cast("bigint"))).bitwiseXOR(F.get(table, F.shiftright(c, 8).bitwiseXOR(b.cast("bigint")).cast("int")))
    return F.aggregate(values, F.lit(first).cast("bigint"), step)
