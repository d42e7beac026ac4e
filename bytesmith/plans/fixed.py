"""Layouts in which every field has a fixed place: whole batches of objects are read by numpy, a column a field.

`plan()` gives the fields in preorder, or None if anything in the layout depends on the bytes (conditions, pointers, varying lengths, repeats,
matches, decodes, division). Objects that are too short for the layout are left to the interpreter, which finds the fault."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.checksums import checksum
from . import ast as A
from .interpreter import MAX_DEPTH, text_of, wrap64

#: Fields at most: a longer array is the interpreter's.
MOST = 512


class Varying(Exception):
    """The layout isn't fixed."""


@dataclass
class Slot:
    """A field: what is the same in all objects, and how its value is read."""

    name: str
    type_name: str
    kind: str  # of a computed field: "computed", which is u or i by sign
    offset: int
    size: int
    parent: int | None
    ordinal: int
    depth: int
    path: str
    pos: str
    description: str = ""
    dtype: str | None = None
    bits: tuple[int, int] | None = None
    names: dict[int, str] | None = None
    expr: object = None
    scope: tuple[int, ...] = ()
    check: tuple[str, int, int] | None = None
    kids: int = 0


class _Planner:
    def __init__(self, schema: A.Schema, big: bool):
        self.schema, self.big, self.slots = schema, big, []

    def add(self, **of) -> int:
        if len(self.slots) >= MOST or of["depth"] > MAX_DEPTH // 4:
            raise Varying
        self.slots.append(Slot(**of))
        if of["parent"] is not None:
            self.slots[of["parent"]].kids += 1
        return len(self.slots) - 1

    def struct(self, name: str, target: A.Struct, at: int, place: dict) -> int:
        me = self.add(name=name, type_name=target.name, kind="struct", offset=at, size=0, **place)
        cursor, scope = at, []
        for f in target.fields:
            if f.pointer is not None or f.condition is not None or f.decode is not None:
                raise Varying
            below = {"parent": me, "ordinal": len(scope), "depth": place["depth"] + 1, "path": f"{place['path']}.{f.name}", "pos": f"{place['pos']}/{len(scope)}"}
            n = self.read(f.type, f.name, cursor, below, scope)
            slot = self.slots[n]
            slot.description = f.description
            if f.check is not None:
                ends = [next((i for i in reversed(scope) if self.slots[i].name == x), None) for x in (f.check.first, f.check.last)]
                if slot.kind != "u" or None in ends:
                    raise Varying
                start, stop = self.slots[ends[0]].offset, self.slots[ends[1]].offset + self.slots[ends[1]].size
                if stop < start:
                    raise Varying
                slot.check = (f.check.algorithm, start, stop)
            cursor += slot.size
            scope.append(n)
        self.slots[me].size = cursor - at
        return me

    def read(self, kind: object, name: str, at: int, place: dict, scope: list[int]) -> int:
        put = lambda value_kind, size, shown=None, **more: self.add(name=name, type_name=shown or str(kind), kind=value_kind, offset=at, size=size, **place, **more)
        if isinstance(kind, A.Prim):
            return put({"u": "u", "i": "i", "f": "f", "b": "bool"}[kind.name[0]], kind.size, dtype=self.dtype(kind, kind.order))
        if isinstance(kind, A.Char):
            return put("char", 1)
        if isinstance(kind, (A.Text, A.Bytes)) or isinstance(kind, A.Array) and isinstance(kind.item, A.Char):
            if not isinstance(kind.length.value, int):
                raise Varying
            return put("bytes" if isinstance(kind, A.Bytes) else "str", kind.length.value)
        if isinstance(kind, A.Array):
            if not isinstance(kind.length.value, int):
                raise Varying
            me, cursor = put("array", 0), at
            for i in range(kind.length.value):
                below = {"parent": me, "ordinal": i, "depth": place["depth"] + 1, "path": f"{place['path']}[{i}]", "pos": f"{place['pos']}/{i}"}
                cursor += self.slots[self.read(kind.item, str(i), cursor, below, [])].size
            self.slots[me].size = cursor - at
            return me
        if isinstance(kind, A.Computed):
            return put("computed", 0, shown="computed", expr=self.resolved(kind.expr, scope))
        target = self.schema.types.get(kind.name) if isinstance(kind, A.Named) else None
        if isinstance(target, A.Struct):
            return self.struct(name, target, at, place)
        if isinstance(target, A.Enum):
            names: dict[int, str] = {}
            for n, v in target.variants:
                names.setdefault(v, n)
            return put("enum", target.repr.size, shown=kind.name, dtype=self.dtype(target.repr, None), names=names)
        if isinstance(target, A.Bitfield):
            size, dtype = target.repr.size, self.dtype(A.Prim(f"u{target.repr.size * 8}"), None)
            me = put("bitfield", size, shown=kind.name, dtype=dtype)
            for i, (m, lo, hi) in enumerate(target.members):
                self.add(name=m, type_name="bit" if lo == hi else f"bits[{lo}..{hi}]", kind="bool" if lo == hi else "u", offset=at, size=size, parent=me, ordinal=i, depth=place["depth"] + 1, path=f"{place['path']}.{m}", pos=f"{place['pos']}/{i}", dtype=dtype, bits=(lo, hi))
            return me
        raise Varying

    def dtype(self, kind: A.Prim, order: str | None) -> str:
        big = self.big if order is None else order == "be"
        return (">" if big else "<") + ("u1" if kind.name == "bool" else f"{kind.name[0]}{kind.size}")

    def resolved(self, expr: object, scope: list[int]) -> object:
        """The expression with slots in place of paths."""
        if isinstance(expr, int):
            return expr
        if isinstance(expr, tuple):
            n = next((i for i in scope if self.slots[i].name == expr[0]), None)
            for part in expr[1:]:
                n = None if n is None else next((i for i, s in enumerate(self.slots) if s.parent == n and s.name == part), None)
            if n is None or self.slots[n].kind not in ("u", "i", "bool", "enum", "computed"):
                raise Varying
            return (n,)
        if expr.op in "/%":
            raise Varying
        return (expr.op, self.resolved(expr.left, scope), self.resolved(expr.right, scope))


def plan(schema: A.Schema, entry: str, endian: str) -> list[Slot] | None:
    planner = _Planner(schema, endian == "be")
    try:
        planner.struct(entry, schema.types[entry], 0, {"parent": None, "ordinal": 0, "depth": 0, "path": entry, "pos": "r"})
    except (Varying, KeyError, AttributeError):
        return None
    return planner.slots


class Reader:
    """Values of the slots over a matrix of bytes, a row an object."""

    def __init__(self, slots: list[Slot], rows: np.ndarray):
        self.slots, self.rows, self.numbers, self.verdicts = slots, rows, {}, {}

    def number(self, n: int) -> np.ndarray:
        """As stored: unsigned, signed or float; bits and flags apart; computed ones as int64."""
        if n not in self.numbers:
            s = self.slots[n]
            if s.kind == "computed":
                with np.errstate(over="ignore"):
                    self.numbers[n] = np.broadcast_to(np.asarray(self.value(s.expr), np.int64), len(self.rows))
            else:
                x = np.ascontiguousarray(self.rows[:, s.offset : s.offset + s.size]).view(s.dtype)[:, 0]
                x = x.astype(x.dtype.newbyteorder("="))
                if s.bits:
                    lo, hi = s.bits
                    x = (x.astype(np.uint64) >> np.uint64(lo)) & np.uint64((1 << (hi - lo + 1)) - 1)
                self.numbers[n] = x
        return self.numbers[n]

    def value(self, expr: object) -> np.ndarray | np.int64:
        """An expression in 64 bits, signed, that wrap."""
        if isinstance(expr, int):
            return np.int64(wrap64(expr))
        if len(expr) == 1:
            x = self.number(expr[0])
            return (x != 0).astype(np.int64) if self.slots[expr[0]].kind == "bool" else x.astype(np.int64)
        a, b = self.value(expr[1]), self.value(expr[2])
        return a + b if expr[0] == "+" else a - b if expr[0] == "-" else a * b

    def pieces(self, n: int) -> list[bytes]:
        s = self.slots[n]
        data, w = np.ascontiguousarray(self.rows[:, s.offset : s.offset + s.size]).tobytes(), s.size
        return [data[i * w : i * w + w] for i in range(len(self.rows))]

    def verdict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Computed and stored checksums."""
        if n not in self.verdicts:
            name, start, stop = self.slots[n].check
            data, w = np.ascontiguousarray(self.rows[:, start:stop]).tobytes(), stop - start
            self.verdicts[n] = np.array([checksum(name, data[i * w : i * w + w]) for i in range(len(self.rows))], np.uint64), self.number(n).astype(np.uint64)
        return self.verdicts[n]

    def failed(self) -> np.ndarray:
        out = np.zeros(len(self.rows), np.int64)
        for n, s in enumerate(self.slots):
            if s.check:
                a, b = self.verdict(n)
                out += a != b
        return out

    def differs(self, n: int, other: Reader) -> np.ndarray:
        """Where the value of a field without children is another one in `other`, which holds as many objects: as it would be shown, so NaN is NaN and -0.0 is not 0.0."""
        s = self.slots[n]
        if s.kind in ("struct", "array"):
            return np.zeros(len(self.rows), bool)
        if s.kind in ("str", "char", "bytes"):
            out = (self.rows[:, s.offset : s.offset + s.size] != other.rows[:, s.offset : s.offset + s.size]).any(axis=1)
            if s.kind == "str" and out.any():
                texts = ([text_of(r.rows[i, s.offset : s.offset + s.size].tobytes()) for i in np.flatnonzero(out)] for r in (self, other))
                out[out] = [x != y for x, y in zip(*texts)]
            return out
        x, y = self.number(n), other.number(n)
        if s.kind == "bool":
            return (x != 0) != (y != 0)
        if s.kind == "f":
            return np.where(x == y, np.signbit(x) != np.signbit(y), ~(np.isnan(x) & np.isnan(y)))
        return x != y

    def lists(self, wanted: list[int], struct: pa.StructType) -> pa.Array:
        """For each object the list of its wanted fields, as structs."""
        rows, m = len(self.rows), len(wanted)
        some = [self.slots[n] for n in wanted]
        tile = pa.array(np.tile(np.arange(m), rows))
        same = lambda values, kind: pa.array(values, kind).take(tile)
        kind_at = {f.name: f.type for f in struct}

        def numbers(fits, dtype, get) -> pa.Array | None:
            """Numbers of the slots that fit, null in the others; rows of a slot may be null too."""
            if not any(map(fits, some)):
                return None
            values, null = np.zeros((rows, m), dtype), np.ones((rows, m), bool)
            for j, (n, s) in enumerate(zip(wanted, some)):
                if fits(s):
                    x, there = get(n, s)
                    values[:, j], null[:, j] = np.where(there, x, 0), ~there
            return pa.array(values.ravel(), mask=null.ravel())

        every = np.ones(rows, bool)
        plain = lambda n, s: (self.number(n), every)
        signed = {j for j, s in enumerate(some) if s.kind == "computed"}
        kinds, at = [*(s.kind for s in some), "u", "i"], np.tile(np.arange(m), (rows, 1))
        for j in signed:
            at[:, j] = m + (self.number(wanted[j]) < 0)
        by_sign = lambda want: lambda n, s: (self.number(n), (self.number(n) < 0) == want) if s.kind == "computed" else (self.number(n), every)
        found = {
            "v_u": numbers(lambda s: s.kind in ("u", "bitfield", "computed"), np.uint64, lambda n, s: (self.number(n).astype(np.uint64), by_sign(False)(n, s)[1])),
            "v_i": numbers(lambda s: s.kind in ("i", "computed"), np.int64, by_sign(True)),
            "v_f": numbers(lambda s: s.kind == "f", np.float64, plain),
            "v_bool": numbers(lambda s: s.kind == "bool", np.bool_, lambda n, s: (self.number(n) != 0, every)),
        }
        texts: dict[str, pa.Array] = {}
        for column, fits in (("v_str", ("str", "char")), ("v_bytes", ("bytes",))):
            if any(s.kind in fits for s in some):
                cells: list = [[None] * rows for _ in some]
                for j, (n, s) in enumerate(zip(wanted, some)):
                    if s.kind in fits:
                        cells[j] = self.pieces(n) if s.kind == "bytes" else [x.decode("latin-1") for x in self.pieces(n)] if s.kind == "char" else [text_of(x) for x in self.pieces(n)]
                texts[column] = pa.array([x for row in zip(*cells) for x in row], kind_at[column])
        columns = {
            "node_id": same(wanted, pa.int32()), "kind": pa.array(kinds).take(pa.array(at.ravel())), "decoded": same([False] * m, pa.bool_()), "space_id": same([0] * m, pa.int32()), "is_leaf": same([not s.kids for s in some], pa.bool_()),
            **{c: same([getattr(s, a) for s in some], kind_at[c]) for c, a in (("parent_id", "parent"), ("ordinal", "ordinal"), ("depth", "depth"), ("path", "path"), ("pos_path", "pos"), ("name", "name"), ("type_name", "type_name"), ("offset", "offset"), ("size", "size"), ("description", "description"))},
            **{c: x.cast(kind_at[c]) for c, x in found.items() if x is not None}, **texts, "v_enum": self.enums(wanted, kind_at["v_enum"]), "check": self.checks(wanted, kind_at["check"]),
        }
        flat = pa.StructArray.from_arrays([pa.nulls(rows * m, f.type) if columns.get(f.name) is None else columns[f.name] for f in struct], fields=list(struct))
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * m, pa.int32()), flat)

    def enums(self, wanted: list[int], kind: pa.StructType) -> pa.Array | None:
        places = [j for j, n in enumerate(wanted) if self.slots[n].kind == "enum"]
        if not places:
            return None
        rows, m = len(self.rows), len(wanted)
        values, name_at, null, names = np.zeros((rows, m), np.int64), np.zeros((rows, m), np.int64), np.ones((rows, m), bool), [None]
        for j in places:
            of, x = self.slots[wanted[j]].names, self.number(wanted[j]).astype(np.int64)
            known, where = np.unique(x, return_inverse=True)
            name_at[:, j] = (np.arange(len(known)) + len(names))[where]
            names += [of.get(int(v)) for v in known]
            values[:, j], null[:, j] = x, False
        return pa.StructArray.from_arrays([pa.array(values.ravel()), pa.array(names, pa.string()).take(pa.array(name_at.ravel()))], fields=list(kind), mask=pa.array(null.ravel()))

    def checks(self, wanted: list[int], kind: pa.StructType) -> pa.Array | None:
        places = [j for j, n in enumerate(wanted) if self.slots[n].check]
        if not places:
            return None
        rows, m = len(self.rows), len(wanted)
        computed, stored, null = np.zeros((rows, m), np.uint64), np.zeros((rows, m), np.uint64), np.ones((rows, m), bool)
        for j in places:
            computed[:, j], stored[:, j] = self.verdict(wanted[j])
            null[:, j] = False
        told = [self.slots[n].check or ("", 0, 0) for n in wanted]
        same = lambda values, t: pa.array(values, t).take(pa.array(np.tile(np.arange(m), rows)))
        types = [f.type for f in kind]
        members = [same([t[0] for t in told], types[0]), pa.array(computed.ravel()).cast(types[1]), pa.array(stored.ravel()).cast(types[2]), pa.array((computed == stored).ravel()), same([t[1] for t in told], types[4]), same([t[2] - t[1] for t in told], types[5])]
        return pa.StructArray.from_arrays(members, fields=list(kind), mask=pa.array(null.ravel()))


def matrix(contents: pa.Array, stride: int) -> np.ndarray:
    """The first `stride` bytes of each, none of which is shorter."""
    _, offsets, data = contents.buffers()
    begin = np.frombuffer(offsets, np.int32)[contents.offset : contents.offset + len(contents)].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[begin[:, None] + np.arange(stride)]
