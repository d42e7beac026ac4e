import pytest

from bytesmith.plans import ast as A
from bytesmith.plans.editing import candidates, insert_fields, validate
from bytesmith.plans.language import KINDS, SchemaError, parse_schema, tokenize, unresolved
from bytesmith.plans.metadata import Metadata, read_metadata, with_metadata

BAD = {
    "unexpected_char": "struct S { a ? }", "int_too_large": "struct S { a u8[18446744073709551616] }", "unterminated_string": 'struct S { a u8 "x }', "unexpected_token": "struct S { a 5 }",
    "unexpected_eof": "struct S { a u8", "length_required": "struct S { a bytes }", "duplicate_type": "struct S { } enum S : u8 { }", "non_integer_repr": "enum E : f32 { }",
    "bit_out_of_range": "bitfield B : u8 { a 8 }", "bad_bit_range": "bitfield B : u8 { a 3..1 }", "unknown_transform": "struct S { a bytes[1] decode rot13 }", "bad_transform_args": "struct S { a bytes[1] decode add(1, 2) }",
    "unknown_checksum": "struct S { a u8 check md5 over(a) }", "expected_over": "struct S { a u8 check crc32 (a) }", "bad_byte_pattern": "struct S { a repeat u8 until 300 }",
}


@pytest.mark.parametrize("kind", KINDS)
def test_errors(kind):
    with pytest.raises(SchemaError) as e:
        parse_schema(BAD[kind])
    assert e.value.kind == kind


def test_tokens_have_places():
    t = tokenize('a 0xFF // no\n "x\\n\\"y"')
    assert [(x.kind, x.value, x.line, x.column) for x in t] == [("word", "a", 1, 1), ("int", 255, 1, 3), ("text", 'x\n"y', 2, 2)]


def test_field_clauses():
    f = parse_schema('struct S { n u8 p at +n T[n] decode xor(1, 2) as T check crc32 over(n .. n) if n >= 2 "why" }').types["S"].fields[1]
    assert f.pointer == A.Pointer(A.Length("n"), True) and str(f.type) == "T[n]" and f.decode == A.Decode("xor", (1, 2), A.Named("T"))
    assert f.check == A.Check("crc32", "n", "n") and f.condition == A.Condition(("n",), ">=", 2) and f.description == "why"


def test_expressions_and_negative_values():
    s = parse_schema("enum E : i8 { m = 0xFFFFFFFFFFFFFFFF } struct S { a u8 x = a + 2 * (a - 1) }")
    assert s.types["E"].variants == (("m", -1),)
    assert s.types["S"].fields[1].type.expr == A.Binary("+", ("a",), A.Binary("*", 2, A.Binary("-", ("a",), 1)))


def test_order_suffix_needs_more_than_a_byte():
    f = parse_schema("struct S { a u16be b u8be }").types["S"].fields
    assert f[0].type == A.Prim("u16", "be") and f[1].type == A.Named("u8be")
    assert unresolved(parse_schema("struct S { a u8be b X[2] }")) == [("S", 1, "u8be"), ("S", 1, "X")]


def test_a_pattern_takes_the_next_arm():
    with pytest.raises(SchemaError):
        parse_schema("struct S { t u8 b match t { 1 => repeat u8 while 0x01 2 => u8 } }")


def test_metadata_round_trip():
    text = "// @name N\n// @endian Big-Endian\n// @other x\nstruct S { }\n"
    assert read_metadata(text) == Metadata("N", None, "be", None)
    new = with_metadata(Metadata("M", "S", "le", "d"), text)
    assert read_metadata(new) == Metadata("M", "S", "le", "d") and "// @other x\nstruct S { }" in new


def test_insert_fields():
    assert insert_fields("struct S {\n    a u8\n}\n", "S", [("a", "u16"), ("if", "u8")]) == "struct S {\n    a u8\n    a2 u16\n    if_ u8\n}\n"
    assert parse_schema(insert_fields("struct S { a u8 }", "S", [("b", "u8")])).types["S"].fields[1].name == "b"
    assert "struct T {" in insert_fields("struct S { }", "T", [("b", "u8")])
    assert insert_fields("struct S { {", "S", [("b", "u8")]) == "struct S { {"


def test_candidates_and_validate():
    assert candidates(4, printable=True) == ["char[4]", "u32", "i32", "f32", "u16[2]", "bytes[4]"] and candidates(0) == []
    assert validate("struct S { }").iloc[0].ok and not validate("struct").iloc[0].ok
