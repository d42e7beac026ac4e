"""The layout language's syntax tree: frozen values that can be shipped to executors."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Prim:
    """A number of fixed width. order: 'be' or 'le' if the schema fixes it, else None."""

    name: str
    order: str | None = None

    @property
    def size(self) -> int:
        return 1 if self.name == "bool" else int(self.name[1:]) // 8

    @property
    def is_integer(self) -> bool:
        return self.name[0] in "ui"

    def __str__(self) -> str:
        return self.name + (self.order or "")


PRIMS = ("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "f32", "f64", "bool")


@dataclass(frozen=True)
class Length:
    """A number, the simple name of an earlier field, or '*' for all that is left."""

    value: int | str

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Varint:
    signed: bool

    def __str__(self) -> str:
        return "svarint" if self.signed else "varint"


@dataclass(frozen=True)
class Char:
    def __str__(self) -> str:
        return "char"


@dataclass(frozen=True)
class CString:
    def __str__(self) -> str:
        return "cstring"


@dataclass(frozen=True)
class Text:
    length: Length

    def __str__(self) -> str:
        return f"string[{self.length}]"


@dataclass(frozen=True)
class Bytes:
    length: Length

    def __str__(self) -> str:
        return f"bytes[{self.length}]"


@dataclass(frozen=True)
class Named:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Array:
    item: object
    length: Length

    def __str__(self) -> str:
        return f"{self.item}[{self.length}]"


@dataclass(frozen=True)
class Match:
    path: tuple[str, ...]
    arms: tuple[tuple[int | str, object], ...]
    default: object | None = None

    def __str__(self) -> str:
        return "match " + ".".join(self.path)


@dataclass(frozen=True)
class Condition:
    """op is None for a test of being other than zero."""

    path: tuple[str, ...]
    op: str | None = None
    value: int | str | None = None


@dataclass(frozen=True)
class Repeat:
    """until: ends after the element for which it holds. pattern: bytes looked for before each element, which
    end it if they are there (stop_on_match) or if they are not."""

    item: object
    until: Condition | None = None
    pattern: bytes | None = None
    stop_on_match: bool = False

    def __str__(self) -> str:
        return f"repeat {self.item}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Computed:
    """expr: an int, a path (tuple of names) or a Binary."""

    expr: object

    def __str__(self) -> str:
        return "computed"


@dataclass(frozen=True)
class Decode:
    name: str
    args: tuple[int, ...] = ()
    as_type: object | None = None


@dataclass(frozen=True)
class Check:
    algorithm: str
    first: str
    last: str


@dataclass(frozen=True)
class Pointer:
    offset: Length
    relative: bool


@dataclass(frozen=True)
class Field:
    name: str
    type: object
    line: int
    pointer: Pointer | None = None
    decode: Decode | None = None
    check: Check | None = None
    condition: Condition | None = None
    description: str = ""


@dataclass(frozen=True)
class Struct:
    name: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Enum:
    name: str
    repr: Prim
    variants: tuple[tuple[str, int], ...]

    def name_of(self, value: int) -> str | None:
        return next((n for n, v in self.variants if v == value), None)


@dataclass(frozen=True)
class Bitfield:
    name: str
    repr: Prim
    members: tuple[tuple[str, int, int], ...]


@dataclass(frozen=True)
class Schema:
    """types: structs, enums and bitfields by name, in the order of their definition."""

    types: dict[str, object] = field(default_factory=dict)

    def of(self, kind: type) -> list:
        return [t for t in self.types.values() if isinstance(t, kind)]

    @property
    def first_struct(self) -> str | None:
        return next((s.name for s in self.of(Struct)), None)
