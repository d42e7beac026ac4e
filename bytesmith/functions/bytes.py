"""Column builders over BINARY: windows, endian numbers, text, needles and in-object search. JVM expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def window(content: Column, offset: Column | int, size: Column | int) -> Column:
    """The bytes at offset, cut at the object's end; empty beyond it, never an error."""
    offset, size = (F.lit(x) if isinstance(x, int) else x for x in (offset, size))
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(content))
    n = F.greatest(F.least(size, F.octet_length(content) - at), F.lit(0))
    return F.substring(content, (at + 1).cast("int"), n.cast("int"))


def head(content: Column, n: int = 512) -> Column:
    return F.substring(content, 1, n)


def exactly(content: Column, offset: Column | int, size: int) -> Column:
    """The bytes at offset, null unless all are there."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.when((offset >= 0) & (offset + size <= F.octet_length(content)), F.substring(content, (offset + 1).cast("int"), F.lit(size)))


def big_hex(data: Column, size: int, big: bool) -> Column:
    """The bytes as hex digits, most significant first."""
    h = F.hex(data)
    return h if big or size == 1 else F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1)])


def unsigned(content: Column, offset: Column | int, size: int, big: bool) -> Column:
    """bigint up to 4 bytes, decimal(20,0) for 8; null if too short."""
    raw = F.conv(big_hex(exactly(content, offset, size), size, big), 16, 10)
    return raw.cast("bigint" if size <= 4 else "decimal(20,0)")


def signed(content: Column, offset: Column | int, size: int, big: bool) -> Column:
    u = unsigned(content, offset, size, big)
    half = 1 << (8 * size - 1)
    if size == 8:
        two = F.lit(str(1 << 64)).cast("decimal(21,0)")
        return F.when(u >= F.lit(str(half)).cast("decimal(20,0)"), (u - two).cast("bigint")).otherwise(u.cast("bigint"))
    return F.when(u >= half, u - (1 << (8 * size))).otherwise(u)


def float_value(content: Column, offset: Column | int, size: int, big: bool) -> Column:
    """An IEEE-754 number as double, from its bits by arithmetic."""
    h = big_hex(exactly(content, offset, size), size, big)
    if size == 4:
        bits = F.conv(h, 16, 10).cast("bigint")
        sign, power, rest, bias, width = F.shiftright(bits, 31), F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND((1 << 23) - 1), 127, 23
    else:
        top, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
        sign, power, rest, bias, width = F.shiftright(top, 31), F.shiftright(top, 20).bitwiseAND(2047), top.bitwiseAND((1 << 20) - 1) * (1 << 32) + low, 1023, 52
    s = F.when(sign == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    part = rest.cast("double") / F.lit(float(1 << width))
    special = F.when(rest == 0, s * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    # Two factors, so that neither leaves the range of doubles.
    scaled = lambda m, e: s * m * F.pow(F.lit(2.0), (e / 2).cast("int")) * F.pow(F.lit(2.0), e - (e / 2).cast("int"))
    return F.when(power == 2 * bias + 1, special).when(power == 0, scaled(part, F.lit(1 - bias))).otherwise(scaled(part + 1, power - bias))


ENCODINGS = {"ascii": "US-ASCII", "utf8": "UTF-8", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE"}


def strict_text(data: Column, encoding: str) -> Column:
    """The decoded text, null if the bytes aren't valid in the encoding."""
    if encoding == "ascii":
        return F.when(~F.hex(data).rlike("^(?:..)*[89A-F]"), F.decode(data, "UTF-8"))
    if encoding == "utf8":
        return F.try_validate_utf8(data.cast("string"))
    even = F.octet_length(data) % 2 == 0
    units = F.hex(data) if encoding == "utf16be" else F.regexp_replace(F.hex(data), "(..)(..)", "$2$1")
    pairs = F.regexp_replace(units, "\\G((?:(?!D[89A-F])....)*)D[89AB]..D[C-F]..", "$1")
    lone = pairs.rlike("^(?:....)*D[89A-F]..")
    return F.when(even & ~lone, F.decode(data, ENCODINGS[encoding]))


def lossy_text(data: Column) -> Column:
    """UTF-8 up to the first NUL, with replacement characters."""
    end = F.instr(latin1(data), "\0")
    cut = F.when(end > 0, F.substring(data, F.lit(1), end - 1)).otherwise(data)
    return F.make_valid_utf8(cut.cast("string"))


def latin1(data: Column) -> Column:
    """A string with a character for each byte, so that its positions are the bytes'."""
    return F.decode(data, "ISO-8859-1")


def interpretations(content: Column, offset: Column | int) -> Column:
    """Struct of the readings at an offset, each null if the object is too short."""
    out = [unsigned(content, offset, 1, True).alias("u8"), signed(content, offset, 1, True).alias("i8")]
    for name, size, make in (("u16", 2, unsigned), ("u32", 4, unsigned), ("u64", 8, unsigned), ("i32", 4, signed), ("f32", 4, float_value), ("f64", 8, float_value)):
        out += [make(content, offset, size, big).alias(f"{name}_{order}") for order, big in (("le", False), ("be", True))]
    return F.struct(*out)


def hex_and_bits(data: Column) -> Column:
    """Struct of spaced hex and binary digits."""
    spaced = F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))
    bits = F.array_join(F.transform(F.split(spaced, " "), lambda h: F.when(h == "", F.lit("")).otherwise(F.lpad(F.conv(h, 16, 2), 8, "0"))), " ")
    return F.struct(spaced.alias("hex"), bits.alias("bits"))


# needles

class NeedleError(ValueError):
    pass


def hex_needle(text: str, *, empty: bool = False, prefix: bool = False) -> bytes:
    """Hex digits with any white space. `empty` allows none (plugin rules); `prefix` allows 0x (editor)."""
    digits = re.sub(r"\s+", "", text)
    if prefix and digits[:2].lower() == "0x":
        digits = digits[2:]
    if not digits and not empty:
        raise NeedleError("no hex digits")
    if len(digits) % 2 or re.search("[^0-9A-Fa-f]", digits):
        raise NeedleError(f"{text!r} is not whole bytes of hex")
    return bytes.fromhex(digits)


def text_needle(text: str, utf16: bool = False) -> bytes:
    return text.encode("utf-16-le" if utf16 else "utf-8")


def integer_needle(text: str, width: int, big: bool = False) -> bytes:
    """A decimal or 0x number in 1, 2, 4 or 8 bytes; a minus sign makes it two's complement."""
    if width not in (1, 2, 4, 8):
        raise NeedleError(f"a width of {width} bytes")
    m = re.fullmatch(r"(-?)(?:0[xX]([0-9A-Fa-f]+)|([0-9]+))", text.strip())
    if not m:
        raise NeedleError(f"{text!r} is no number")
    n = int(m[2], 16) if m[2] else int(m[3])
    n = -n if m[1] else n
    if not -(1 << (8 * width - 1)) <= n < 1 << (8 * width):
        raise NeedleError(f"{text} doesn't fit {width} bytes")
    return (n % (1 << (8 * width))).to_bytes(width, "big" if big else "little")


def needle(kind: str, text: str, *, width: int = 4, big: bool = False) -> bytes:
    """By kind: hex, text, utf16 or value."""
    if kind == "hex":
        return hex_needle(text)
    if kind == "value":
        return integer_needle(text, width, big)
    if kind in ("text", "utf16"):
        return text_needle(text, kind == "utf16")
    raise NeedleError(f"no such kind of search: {kind}")


def find_from(content: Column, sought: bytes, start: Column | int) -> Column:
    """Offset of the first match at or after start, null if there is none. An empty needle matches nothing."""
    if not sought:
        return F.lit(None).cast("bigint")
    start = F.lit(start) if isinstance(start, int) else start
    at = F.call_function("locate", F.lit(sought.decode("latin-1")), latin1(content), (start + 1).cast("int"))
    return F.when((at > 0) & (start <= F.octet_length(content)), (at - 1).cast("bigint"))
