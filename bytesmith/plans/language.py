"""From schema text to syntax tree: one regular expression for tokens, recursive descent over their list."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import ast as A

#: Reserved words, and names of transforms with their numbers of arguments (None: one or more).
RESERVED = ("struct", "enum", "bitfield", "if", "at", "match", "repeat", "until", "while", "decode", "as", "check")
TRANSFORMS = {"xor": None, "rolling_xor": 3, "add": 1, "sub": 1, "base64": 0, "zlib_inflate": 0, "inflate": 0, "gunzip": 0}
TRANSFORM_ALIASES = {"zlib": "zlib_inflate", "deflate_raw": "inflate", "gzip": "gunzip"}
CHECKSUMS = ("crc32", "adler32", "crc16", "crc16_modbus", "crc16_ccitt", "crc16_xmodem", "sum8", "sum16", "sum32", "xor8")
KINDS = (
    "unexpected_char", "int_too_large", "unterminated_string", "unexpected_token", "unexpected_eof", "length_required", "duplicate_type", "non_integer_repr",
    "bit_out_of_range", "bad_bit_range", "unknown_transform", "bad_transform_args", "unknown_checksum", "expected_over", "bad_byte_pattern",
)


class SchemaError(ValueError):
    """kind is one of KINDS; line and column count from 1, and are None at the end of the text."""

    def __init__(self, kind: str, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message + (f" ({line}:{column})" if line else ""))
        self.kind, self.line, self.column = kind, line, column


class Token(NamedTuple):
    kind: str  # word, int, text, or the sign itself
    value: object
    line: int
    column: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<hex>0[xX][0-9A-Fa-f]+)|(?P<int>[0-9]+)
    |(?P<text>"(?:[^"\\]|\\.)*")|(?P<sign>==|!=|<=|>=|=>|\.\.|[{}\[\]():=<>.,+\-*/%])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t"}


def tokenize(text: str) -> list[Token]:
    out, at, line, begin = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        column = at - begin + 1
        if not m:
            if text[at] == '"':
                raise SchemaError("unterminated_string", "a string has no end", line, column)
            raise SchemaError("unexpected_char", f"{text[at]!r} can't stand here", line, column)
        kind, value = m.lastgroup, m[0]
        if kind in ("hex", "int"):
            value = int(value, 16 if kind == "hex" else 10)
            if value >= 1 << 64:
                raise SchemaError("int_too_large", "a number is over 64 bits", line, column)
            out.append(Token("int", value, line, column))
        elif kind == "text":
            out.append(Token("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S), line, column))
        elif kind == "word":
            out.append(Token(value if value in RESERVED else "word", value, line, column))
        elif kind == "sign":
            out.append(Token(value, value, line, column))
        if breaks := m[0].count("\n"):
            line, begin = line + breaks, at + m[0].rindex("\n") + 1
        at = m.end()
    return out


def signed64(n: int) -> int:
    """Numbers are unsigned in the text and signed 64-bit in values and comparisons."""
    return n - (1 << 64) if n >> 63 else n


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def sees(self, *kinds: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind in kinds

    def sees_word(self, word: str) -> bool:
        return self.sees("word") and self.tokens[self.at].value == word

    def take(self, kind: str, what: str) -> Token:
        if self.at >= len(self.tokens):
            raise SchemaError("unexpected_eof", f"the text ends where {what} should be")
        t = self.tokens[self.at]
        if t.kind != kind:
            raise self.bad(what)
        self.at += 1
        return t

    def bad(self, what: str) -> SchemaError:
        if self.at >= len(self.tokens):
            return SchemaError("unexpected_eof", f"the text ends where {what} should be")
        t = self.tokens[self.at]
        return SchemaError("unexpected_token", f"{what} should be here, not {t.value!r}", t.line, t.column)

    def skip(self, kind: str) -> bool:
        found = self.sees(kind)
        self.at += found
        return found

    def body(self, item) -> tuple:
        self.take("{", "'{'")
        out = []
        while not self.skip("}"):
            out.append(item())
        return tuple(out)

    # definitions

    def schema(self) -> A.Schema:
        types: dict[str, object] = {}
        while self.at < len(self.tokens):
            start = self.tokens[self.at]
            make = {"struct": self.struct, "enum": self.enum, "bitfield": self.bitfield}.get(start.kind)
            if not make:
                raise self.bad("struct, enum or bitfield")
            self.at += 1
            made = make(self.take("word", "a name").value)
            if made.name in types:
                raise SchemaError("duplicate_type", f"{made.name} is defined twice", start.line, start.column)
            types[made.name] = made
        return A.Schema(types)

    def struct(self, name: str) -> A.Struct:
        return A.Struct(name, self.body(self.field))

    def integer_repr(self) -> A.Prim:
        self.take(":", "':'")
        t = self.take("word", "an integer type")
        if t.value not in A.PRIMS or t.value[0] not in "ui":
            raise SchemaError("non_integer_repr", f"{t.value} is no integer type", t.line, t.column)
        return A.Prim(t.value)

    def enum(self, name: str) -> A.Enum:
        def variant():
            key = self.take("word", "a variant's name").value
            self.take("=", "'='")
            return key, signed64(self.take("int", "a variant's value").value)

        return A.Enum(name, self.integer_repr(), self.body(variant))

    def bitfield(self, name: str) -> A.Bitfield:
        base = self.integer_repr()

        def member():
            key = self.take("word", "a member's name").value
            lo = hi = self.take("int", "a bit")
            if self.skip(".."):
                hi = self.take("int", "the highest bit")
                if hi.value < lo.value:
                    raise SchemaError("bad_bit_range", f"bits {lo.value}..{hi.value} run backwards", hi.line, hi.column)
            if hi.value >= base.size * 8:
                raise SchemaError("bit_out_of_range", f"{base} has no bit {hi.value}", lo.line, lo.column)
            return key, lo.value, hi.value

        return A.Bitfield(name, base, self.body(member))

    # fields

    def field(self) -> A.Field:
        name = self.take("word", "a field's name")
        if self.skip("="):
            return A.Field(name.value, A.Computed(self.sum()), name.line, description=self.description())
        pointer = A.Pointer(relative=self.skip("+"), offset=self.length()) if self.skip("at") else None
        kind = self.type()
        decode = self.decode() if self.skip("decode") else None
        check = self.check() if self.skip("check") else None
        condition = self.condition() if self.skip("if") else None
        return A.Field(name.value, kind, name.line, pointer, decode, check, condition, self.description())

    def description(self) -> str:
        return self.take("text", "").value if self.sees("text") else ""

    def length(self) -> A.Length:
        if self.sees("int", "word", "*"):
            self.at += 1
            return A.Length(self.tokens[self.at - 1].value)
        raise self.bad("a number, a field's name or '*'")

    def type(self) -> object:
        if self.skip("match"):
            return self.match()
        if self.skip("repeat"):
            return self.repeat()
        t = self.take("word", "a type")
        length = None
        if self.skip("["):
            length = self.length()
            self.take("]", "']'")
        if t.value in ("string", "bytes"):
            if length is None:
                raise SchemaError("length_required", f"{t.value} needs a length", t.line, t.column)
            return (A.Text if t.value == "string" else A.Bytes)(length)
        item = self.plain(t.value)
        return item if length is None else A.Array(item, length)

    @staticmethod
    def plain(word: str) -> object:
        if word in A.PRIMS:
            return A.Prim(word)
        stem, order = word[:-2], word[-2:]
        if order in ("be", "le") and stem in A.PRIMS and A.Prim(stem).size > 1:
            return A.Prim(stem, order)
        return {"varint": A.Varint(False), "svarint": A.Varint(True), "char": A.Char(), "cstring": A.CString()}.get(word) or A.Named(word)

    def path(self) -> tuple[str, ...]:
        out = [self.take("word", "a field's name").value]
        while self.skip("."):
            out.append(self.take("word", "a field's name").value)
        return tuple(out)

    def condition(self) -> A.Condition:
        path = self.path()
        if not self.sees("==", "=", "!=", "<", "<=", ">", ">="):
            return A.Condition(path)
        op = self.take(self.tokens[self.at].kind, "").value
        value = self.take("text", "").value if self.sees("text") else signed64(self.take("int", "a number or a string").value)
        return A.Condition(path, "==" if op == "=" else op, value)

    def match(self) -> A.Match:
        path, default = self.path(), []

        def arm():
            if self.sees("int"):
                key = signed64(self.take("int", "").value)
            elif self.sees("text"):
                key = self.take("text", "").value
            elif self.sees_word("default"):
                self.at += 1
                key = None
            else:
                raise self.bad("a number, a string, default or '}'")
            self.take("=>", "'=>'")
            kind = self.type()
            if key is None:
                default.append(kind)
            return key, kind

        arms = self.body(arm)
        return A.Match(path, tuple(a for a in arms if a[0] is not None), default[-1] if default else None)

    def repeat(self) -> A.Repeat:
        item = self.type()
        if self.skip("until"):
            return A.Repeat(item, pattern=self.pattern(), stop_on_match=True) if self.sees("int") else A.Repeat(item, until=self.condition())
        return A.Repeat(item, pattern=self.pattern()) if self.skip("while") else A.Repeat(item)

    def pattern(self) -> bytes:
        """Takes every number that follows, even the key of the next arm of a match."""
        out = []
        while not out or self.sees("int"):
            t = self.take("int", "a byte")
            if t.value > 255:
                raise SchemaError("bad_byte_pattern", f"{t.value} is no byte", t.line, t.column)
            out.append(t.value)
        return bytes(out)

    def decode(self) -> A.Decode:
        t, args = self.take("word", "a transform"), []
        if self.skip("("):
            while not self.sees(")"):
                args.append(signed64(self.take("int", "an argument").value))
                if not self.skip(","):
                    break
            self.take(")", "')'")
        name = TRANSFORM_ALIASES.get(t.value, t.value)
        if name not in TRANSFORMS:
            raise SchemaError("unknown_transform", f"there is no transform {t.value}", t.line, t.column)
        wanted = TRANSFORMS[name]
        if len(args) != wanted if wanted is not None else not args:
            raise SchemaError("bad_transform_args", f"{t.value} takes {'some' if wanted is None else wanted} arguments, not {len(args)}", t.line, t.column)
        if name == "sub":
            name, args = "add", [-args[0]]
        return A.Decode(name, tuple(args), self.type() if self.skip("as") else None)

    def check(self) -> A.Check:
        t = self.take("word", "a checksum")
        if t.value not in CHECKSUMS:
            raise SchemaError("unknown_checksum", f"there is no checksum {t.value}", t.line, t.column)
        if not self.sees_word("over"):
            here = self.tokens[self.at] if self.at < len(self.tokens) else t
            raise SchemaError("expected_over", f"check {t.value} needs over(...)", here.line, here.column)
        self.at += 1
        self.take("(", "'('")
        first = last = self.take("word", "a field's name").value
        if self.skip(".."):
            last = self.take("word", "a field's name").value
        self.take(")", "')'")
        return A.Check(t.value, first, last)

    # expressions

    def sum(self) -> object:
        out = self.product()
        while self.sees("+", "-"):
            out = A.Binary(self.take(self.tokens[self.at].kind, "").value, out, self.product())
        return out

    def product(self) -> object:
        out = self.atom()
        while self.sees("*", "/", "%"):
            out = A.Binary(self.take(self.tokens[self.at].kind, "").value, out, self.atom())
        return out

    def atom(self) -> object:
        if self.sees("int"):
            return signed64(self.take("int", "").value)
        if self.skip("("):
            out = self.sum()
            self.take(")", "')'")
            return out
        if self.sees("word"):
            return self.path()
        raise self.bad("a number, a field or '('")


def parse_schema(text: str) -> A.Schema:
    """The schema of a text; names are resolved when it runs. Raises SchemaError."""
    return _Parser(tokenize(text)).schema()


def unresolved(schema: A.Schema) -> list[tuple[str, int, str]]:
    """(struct, line, name) of types that are not defined: an eager check that running doesn't need."""
    out = []

    def look(struct: str, line: int, kind: object) -> None:
        if isinstance(kind, A.Named) and kind.name not in schema.types:
            out.append((struct, line, kind.name))
        for inner in (getattr(kind, "item", None), getattr(kind, "default", None), *(t for _, t in getattr(kind, "arms", ()))):
            if inner is not None:
                look(struct, line, inner)

    for s in schema.of(A.Struct):
        for f in s.fields:
            look(s.name, f.line, f.type)
            if f.decode and f.decode.as_type is not None:
                look(s.name, f.line, f.decode.as_type)
    return out
