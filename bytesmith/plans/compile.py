"""Compiles a schema to Column expressions: every offset and value is an expression, so Catalyst prunes the fields that nobody asks for and
whole-stage code runs the rest. No Python touches the data.

Admissible: numbers, char, texts and bytes of any length, enums, bitfields, nested structs, pointers, conditions, computed fields,
checksums over earlier fields, and arrays or repeats (to the end) of elements whose size is fixed. Anything else raises NotAdmissible, and the
interpreter takes it. A field that doesn't fit, and all after it, are null; `_ok` says whether everything fitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions.checksums import checksum_column
from . import ast as A
from .language import parse_schema


class NotAdmissible(ValueError):
    pass


@dataclass
class Part:
    """A compiled field: its value, the value as a 64-bit number or text where it has one, and its span."""

    value: Column
    number: Column | None
    text: Column | None
    offset: Column
    size: Column
    parts: dict[str, Part]


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


class Compiler:
    def __init__(self, schema: A.Schema, endian: str, content: Column):
        self.schema, self.big, self.content = schema, endian == "be", content
        self.total = F.octet_length(content).cast("bigint")

    # sizes that the schema alone fixes

    def fixed(self, kind: object) -> int:
        if isinstance(kind, A.Prim):
            return kind.size
        if isinstance(kind, A.Char):
            return 1
        if isinstance(kind, A.Computed):
            return 0
        if isinstance(kind, A.Text | A.Bytes) and isinstance(kind.length.value, int):
            return kind.length.value
        if isinstance(kind, A.Array) and isinstance(kind.length.value, int):
            return kind.length.value * self.fixed(kind.item)
        target = self.schema.types.get(kind.name) if isinstance(kind, A.Named) else None
        if isinstance(target, A.Enum | A.Bitfield):
            return target.repr.size
        if isinstance(target, A.Struct):
            if any(f.condition or f.decode for f in target.fields):
                raise NotAdmissible(f"{target.name} has fields that may be absent")
            return sum(self.fixed(f.type) for f in target.fields if f.pointer is None)
        raise NotAdmissible(f"{kind} has no fixed size")

    # fields

    def struct(self, target: A.Struct, at: Column, alive: Column) -> tuple[Part, Column]:
        scope: dict[str, Part] = {}
        cursor = at
        for f in target.fields:
            if f.decode is not None:
                raise NotAdmissible(f"{f.name} is decoded")
            here = alive
            present = None
            if f.condition is not None:
                present = self.holds(f.condition, scope)
                here = alive & F.coalesce(present, F.lit(False))
            start = cursor
            if f.pointer is not None:
                start = self.length(f.pointer.offset, scope, at) + (at if f.pointer.relative else _long(0))
            part, fits = self.type(f.type, start, here, scope)
            if f.check is not None:
                part = self.checked(f, part, scope)
            if present is not None:
                absent = ~F.coalesce(present, F.lit(False))
                part = Part(F.when(~absent, part.value), part.number, part.text, part.offset, F.when(absent, _long(0)).otherwise(part.size), part.parts)
                fits = absent | fits
            alive = alive & F.coalesce(fits, F.lit(False))
            if f.pointer is None:
                cursor = cursor + part.size
            scope.setdefault(f.name, part)
        return Part(F.struct(*[p.value.alias(n) for n, p in scope.items()]), None, None, at, cursor - at, scope), alive

    def checked(self, f: A.Field, part: Part, scope: dict[str, Part]) -> Part:
        if f.check.first not in scope or f.check.last not in scope or part.number is None:
            raise NotAdmissible(f"{f.name} is checked over fields that don't come before it")
        first, last = scope[f.check.first], scope[f.check.last]
        over = B.window(self.content, first.offset, last.offset + last.size - first.offset)
        computed = checksum_column(f.check.algorithm, over)
        value = F.when(part.number.isNotNull(), F.struct(part.number.alias("stored"), computed.alias("computed"), (part.number == computed).alias("ok")))
        return Part(value, part.number, None, part.offset, part.size, {})

    def type(self, kind: object, at: Column, alive: Column, scope: dict[str, Part]) -> tuple[Part, Column]:
        """The part, and whether it fits; it isn't read unless `alive`."""
        if isinstance(kind, A.Prim):
            return self.prim(kind, at, alive)
        if isinstance(kind, A.Char):
            fits = at + 1 <= self.total
            value = F.when(alive & fits, F.decode(F.substring(self.content, (at + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            return Part(value, None, None, at, _long(1), {}), fits
        if isinstance(kind, A.Array) and isinstance(kind.item, A.Char):
            return self.type(A.Text(kind.length), at, alive, scope)
        if isinstance(kind, A.Text | A.Bytes):
            n = self.length(kind.length, scope, at)
            fits = at + n <= self.total
            raw = F.when(alive & fits, F.substring(self.content, (at + 1).cast("int"), n.cast("int")))
            value = B.lossy_text(raw) if isinstance(kind, A.Text) else raw
            return Part(value, None, value if isinstance(kind, A.Text) else None, at, n, {}), fits
        if isinstance(kind, A.Computed):
            v = self.compute(kind.expr, scope)
            return Part(v, v, None, at, _long(0), {}), v.isNotNull()
        if isinstance(kind, A.Array | A.Repeat):
            return self.many(kind, at, alive, scope)
        if isinstance(kind, A.Named):
            target = self.schema.types.get(kind.name)
            if isinstance(target, A.Struct):
                part, ok = self.struct(target, at, alive)
                return part, ok
            if isinstance(target, A.Enum):
                part, fits = self.prim(target.repr, at, alive)
                names: dict[int, str] = {}
                for n, v in target.variants:
                    names.setdefault(v, n)
                number = part.number
                name = F.coalesce(*[F.when(number == v, F.lit(n)) for v, n in names.items()], F.lit(None).cast("string"))
                return Part(F.when(number.isNotNull(), F.struct(number.alias("value"), name.alias("name"))), number, None, at, part.size, {}), fits
            if isinstance(target, A.Bitfield):
                if target.repr.size == 8:
                    raise NotAdmissible("bitfields of 64 bits")
                part, fits = self.prim(A.Prim("u" + target.repr.name[1:], target.repr.order), at, alive)
                bits = {}
                for name, lo, hi in target.members:
                    v = F.shiftright(part.number, lo).bitwiseAND((1 << (hi - lo + 1)) - 1)
                    bits[name] = Part(v == 1 if lo == hi else v, v, None, at, part.size, {})
                return Part(F.when(part.number.isNotNull(), F.struct(*[p.value.alias(n) for n, p in bits.items()])), part.number, None, at, part.size, bits), fits
        raise NotAdmissible(f"{kind} doesn't compile to expressions")

    def prim(self, kind: A.Prim, at: Column, alive: Column) -> tuple[Part, Column]:
        big = self.big if kind.order is None else kind.order == "be"
        fits = at + kind.size <= self.total
        if kind.name == "bool":
            n = B.unsigned(self.content, at, 1, big)
            value, number = n != 0, (n != 0).cast("bigint")
        elif kind.name[0] == "f":
            value, number = B.float_value(self.content, at, kind.size, big), None
        elif kind.name[0] == "u":
            value = B.unsigned(self.content, at, kind.size, big)
            number = value if kind.size < 8 else B.signed(self.content, at, 8, big)
        else:
            value = number = B.signed(self.content, at, kind.size, big)
        guard = lambda c: None if c is None else F.when(alive, c)
        return Part(guard(value), guard(number), None, at, _long(kind.size), {}), fits

    def many(self, kind: A.Array | A.Repeat, at: Column, alive: Column, scope: dict[str, Part]) -> tuple[Part, Column]:
        if isinstance(kind, A.Repeat) and (kind.until is not None or kind.pattern is not None):
            raise NotAdmissible(f"{kind} ends where its elements say")
        stride = self.fixed(kind.item)
        if not stride:
            raise NotAdmissible(f"{kind} has elements without bytes")
        room = self.total - at
        if isinstance(kind, A.Repeat):
            n, fits = F.floor(room / stride).cast("bigint"), room % stride == 0
        else:
            n = self.length(kind.length, scope, at)
            fits = at + n * stride <= self.total
        whole = F.least(n, F.floor(room / stride).cast("bigint"))
        one = lambda i: self.type(kind.item, at + i * stride, F.lit(True), {})[0].value
        value = F.when(alive & (whole > 0), F.transform(F.sequence(_long(0), whole - 1), one)).when(alive, F.transform(F.array().cast("array<bigint>"), one))
        return Part(value, None, None, at, n * stride, {}), fits

    # references

    def lookup(self, path: tuple[str, ...], scope: dict[str, Part]) -> Part:
        part = None
        for name in path:
            if name not in scope:
                raise NotAdmissible(f"no earlier field {'.'.join(path)}")
            part, scope = scope[name], scope[name].parts
        return part

    def length(self, length: A.Length, scope: dict[str, Part], at: Column) -> Column:
        if isinstance(length.value, int):
            return _long(length.value)
        if length.value == "*":
            return F.greatest(self.total - at, _long(0))
        n = self.lookup((length.value,), scope).number
        if n is None:
            raise NotAdmissible(f"{length.value} is no number")
        return F.when(n >= 0, n)

    def holds(self, c: A.Condition, scope: dict[str, Part]) -> Column:
        part = self.lookup(c.path, scope)
        left = part.text if isinstance(c.value, str) else part.number
        if left is None:
            raise NotAdmissible(f"{'.'.join(c.path)} can't be tested so")
        right = F.lit(c.value) if isinstance(c.value, str) else _long(c.value or 0)
        return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, None: left != 0}[c.op]

    def compute(self, expr: object, scope: dict[str, Part]) -> Column:
        """64 bits that wrap; null on division by zero."""
        if isinstance(expr, int):
            return _long(expr)
        if isinstance(expr, tuple):
            n = self.lookup(expr, scope).number
            if n is None:
                raise NotAdmissible(f"{'.'.join(expr)} is no number")
            return n
        a, b = self.compute(expr.left, scope), self.compute(expr.right, scope)
        if expr.op == "%":
            return F.when(b == -1, _long(0)).when(b != 0, F.call_function("try_mod", a, b))
        if expr.op == "/":  # by -1 the least number wraps round
            return F.when(b == -1, _wrap(-a.cast("decimal(38,0)"))).when(b != 0, _quotient(a, b))
        wide = [x.cast("decimal(38,0)") for x in (a, b)]
        return _wrap({"+": wide[0] + wide[1], "-": wide[0] - wide[1], "*": wide[0] * wide[1]}[expr.op])


def _quotient(a: Column, b: Column) -> Column:
    """Towards zero, by way of the remainder, which has the sign of a."""
    rest = F.call_function("try_mod", a, b)
    return F.call_function("try_divide", (a - rest).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("bigint")


def _wrap(n: Column) -> Column:
    """A whole number of up to 38 digits as 64 signed bits."""
    two64, half = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (64, 63))
    return (F.pmod(n + half, two64) - half).cast("bigint")


def compiled(content: Column, schema_text: str, entry: str, endian: str = "le") -> Column:
    """A struct of the entry's fields and `_ok`. Raises NotAdmissible if the schema needs the interpreter."""
    schema = parse_schema(schema_text)
    target = schema.types.get(entry)
    if not isinstance(target, A.Struct):
        raise NotAdmissible(f"there is no struct {entry}")
    part, ok = Compiler(schema, endian, content).struct(target, _long(0), F.lit(True))
    return F.struct(*[p.value.alias(n) for n, p in part.parts.items()], F.coalesce(ok, F.lit(False)).alias("_ok"))


def project(objects: DataFrame, schema_text: str, entry: str, endian: str = "le", content: str = "content") -> DataFrame:
    """objects without their content, with the entry's fields as columns of `record`."""
    return objects.withColumn("record", compiled(F.col(content), schema_text, entry, endian)).drop(content)
