import base64
import gzip
import io
import json
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytesmith.functions.checksums import checksum, checksum_column
from bytesmith.functions.transforms import TransformError, apply_transform
from bytesmith.operators import parse as P
from bytesmith.plans.compile import NotAdmissible, compiled
from bytesmith.plans.interpreter import Program, Stop, coverage_of, leaf_spans
from bytesmith.plans.language import parse_schema
from bytesmith.sources.catalog import built_in


def run(text, data, entry="S", endian="le", **kw):
    return Program(parse_schema(text), **kw).run(data, entry, endian)


def values(node):
    return {c.name: values(c) if c.kind == "struct" else [values(x) if x.kind == "struct" else x.value for x in c.children] if c.kind == "array" else c.value for c in node.children}


def test_check_values():
    expected = {"crc32": 0xCBF43926, "crc16": 0xBB3D, "crc16_modbus": 0x4B37, "crc16_ccitt": 0x29B1, "crc16_xmodem": 0x31C3}
    for name, v in expected.items():
        assert checksum(name, b"123456789") == v
    assert checksum("adler32", b"Wikipedia") == 0x11E60398 and checksum("crc32", b"IEND") == 0xAE426082 and checksum("sum8", b"\xff" * 3) == 253 and checksum("xor8", b"\x05\x03") == 6


def test_checksum_columns(spark):
    names = ["crc32", "adler32", "crc16", "crc16_modbus", "crc16_ccitt", "crc16_xmodem", "sum8", "sum16", "sum32", "xor8"]
    data = [b"123456789", b"", b"\xff" * 300, bytes(range(256))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, c binary").select("i", *[checksum_column(n, F.col("c")).alias(n) for n in names]).collect()
    for r in rows:
        assert [r[n] for n in names] == [checksum(n, data[r.i]) for n in names]


@given(st.binary(max_size=700), st.integers(0, 255), st.integers(0, 255), st.integers(0, 255))
@settings(max_examples=60, deadline=None)
def test_transforms(data, a, b, c):
    assert apply_transform("xor", (a, b, c), apply_transform("xor", (a, b, c), data)) == data
    assert apply_transform("add", (-a,), apply_transform("add", (a,), data)) == data
    k, want = a, bytearray()
    for x in data:
        want.append(x ^ k)
        k = (k * b + c) % 256
    assert apply_transform("rolling_xor", (a, b, c), data) == bytes(want)
    assert apply_transform("base64", (), base64.encodebytes(data)) == data
    assert apply_transform("zlib_inflate", (), zlib.compress(data) + b"tail") == data and apply_transform("gunzip", (), gzip.compress(data) + gzip.compress(b"two")) == data


def test_broken_transforms():
    for name, data in (("zlib_inflate", b"junk"), ("zlib_inflate", zlib.compress(b"x" * 99)[:-5]), ("base64", b"a*b")):
        with pytest.raises(TransformError):
            apply_transform(name, (), data)


def test_scalars_and_order():
    text = "enum E : u8 { one = 1 uno = 1 } bitfield B : u16 { lo 0 mid 1..3 } struct S { a u16 b u16be c i8 d f32 e bool f E g B h char i char[4] j string[3] k bytes[2] }"
    o = run(text, struct.pack("<HHbf?B", 1, 0x0200, -1, 1.5, True, 1) + struct.pack("<H", 0b1011) + b"xab\0d\xff\0zQQ")
    v = values(o.tree)
    assert o.fault is None and (v["a"], v["b"], v["c"], v["d"], v["e"], v["f"]) == (1, 2, -1, 1.5, True, (1, "one"))
    assert [c.value for c in o.tree.child("g").children] == [True, 5] and (v["h"], v["i"], v["j"], v["k"]) == ("x", "ab", "�", b"QQ")


@pytest.mark.parametrize(("data", "kind", "value"), [(b"\x7f", "varint", 127), (b"\xac\x02", "varint", 300), (b"\x7f", "svarint", -1), (b"\xc0\x00", "svarint", 64)])
def test_varints(data, kind, value):
    assert run(f"struct S {{ a {kind} }}", data).tree.children[0].value == value


def test_varint_too_long():
    assert run("struct S { a varint }", b"\x80" * 11).fault.kind == "data"


def test_pointers_conditions_computed():
    o = run("struct S { at_ u8 n = at_ * 2 - 1 far at at_ u8[n] near at +1 u8 opt u8 if at_ > 9 two u8 if at_ == 2 }", bytes([2, 7, 5, 6, 8]))
    v = values(o.tree)
    assert v == {"at_": 2, "n": 3, "far": [5, 6, 8], "near": 7, "two": 7} and o.tree.size == 2
    assert run("struct S { a u8 b = a / 0 }", b"\x01").fault.kind == "data"
    assert run("struct S { a i8 b = a / 2 c = a % 2 }", b"\xf9").tree.child("b").value == -3


def test_repeat_rules():
    tlv = "struct C { tag char[4] n u32 body bytes[n] } struct S { cs repeat C until tag == \"ENDF\" tail u32be }"
    data = b"".join(t + struct.pack("<I", len(b)) + b for t, b in ((b"PLYR", b"xy"), (b"META", b""), (b"ENDF", b""))) + b"\xde\xad\xbe\xef"
    o = run(tlv, data)
    assert len(o.tree.children[0].children) == 3 and o.tree.children[1].value == 0xDEADBEEF
    o = run("struct S { a repeat u16 while 0xAA b u8 }", b"\xaa\x01\xaa\x02\xbb")
    assert len(o.tree.children[0].children) == 2 and o.tree.children[1].value == 0xBB
    assert run("struct Z { } struct S { a repeat Z }", b"abc").tree.children[0].size == 0
    o = run("struct Z { k = 1 } struct S { a repeat Z until k == 2 }", b"abc", max_repeats=50)
    assert o.fault.kind == "limit" and o.tree.children == []


FAULTS = [
    ("struct S { magic char[4] version u16 size u32 }", b"ABCD\x01\x00", "S.size", 6, "out_of_bounds", False),
    ("struct I { a u32 b u32 } struct S { items repeat I }", b"\0" * 14, "S.items[1].b", 12, "out_of_bounds", False),
    ("struct P { x u16 y u16 } struct S { n u8 xs P[n] }", b"\x03" + b"\0" * 10, "S.xs[2].y", 11, "out_of_bounds", False),
    ("struct I { a u32 b u32 } struct S { blob bytes[*] decode xor(0) as I }", b"\0" * 6, "S.blob.b", 4, "out_of_bounds", True),
    ("struct S {\n a u32\n b Nope\n}", b"\0" * 8, "S.b", 4, "schema", False),
    ("struct S { a u32 }", b"", "S.a", 0, "out_of_bounds", False),
]


@pytest.mark.parametrize(("text", "data", "path", "offset", "kind", "decoded"), FAULTS)
def test_faults(text, data, path, offset, kind, decoded):
    f = run(text, data).fault
    assert (f.path, f.offset, f.kind, f.decoded) == (path, offset, kind, decoded)


def test_depth_and_missing_entry():
    assert run("struct S { a S }", b"").fault.kind == "limit"
    with pytest.raises(Stop):
        run("struct S { }", b"", entry="T")


def test_depth_at_a_low_recursion_limit():
    import inspect
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(len(inspect.stack()) + 60)
    try:
        o = run("struct S { a S }", b"")
    finally:
        sys.setrecursionlimit(limit)
    assert o.fault.kind == "limit" and o.fault.path.count(".a") > 100
    assert json.loads(P.outcome_json(o))["fault"]["kind"] == "limit" and P.tree_text(o.tree).count("\n") > 100


def test_depth_in_spark(spark):
    rows = P.parse(spark.createDataFrame([("a", b"x"), ("b", b"")], "object_id string, content binary"), "struct S { a S }", render=True).collect()
    assert [r.fault.kind for r in rows] == ["limit"] * 2


def test_checks_and_coverage():
    o = run('struct S { tag char[4] v u32 crc u32 check crc32 over(tag .. v) }', b"TAG!" + struct.pack("<I", 42) + struct.pack("<I", 0x77412FA2))
    assert o.tree.children[2].check["ok"]
    o = run("struct S { a u8 b at 4 u16 c at 5 u16 }", bytes(10))
    assert coverage_of(leaf_spans(o.tree), 10) == {"total": 10, "covered": 4, "gaps": [{"offset": 1, "len": 3}, {"offset": 7, "len": 3}], "truncated": False}
    assert coverage_of([], 0)["covered"] == 0 and coverage_of([(0, 99)], 10)["covered"] == 10
    cut = coverage_of([(i, i + 1) for i in range(0, 20, 2)], 20, most=3)
    assert cut["truncated"] and len(cut["gaps"]) == 3


def png():
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", b"abcd") + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("hello", "world")
    return out.getvalue()


def elf():
    head = b"\x7fELF\x02\x01\x01\0" + bytes(8) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 120, 0, 64, 56, 1, 64, 1, 0)
    return head + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 0, 0, 0) + struct.pack("<IIQQQQIIQQ", 0, 1, 6, 0, 0, 0, 0, 0, 0, 0)


def pe():
    optional = struct.pack("<HBBIIIIII", 0x10B, 1, 2, 3, 4, 5, 6, 7, 8) + struct.pack("<I", 9) + struct.pack("<IIHHHHHHIIIIHH", 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 3, 0) + struct.pack("<IIIIII", 1, 1, 1, 1, 0, 1) + bytes(8)
    section = b".text\0\0\0" + struct.pack("<IIIIIIHHI", 1, 2, 3, 4, 0, 0, 0, 0, 1 << 29)
    return b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 2) + optional + section


def wasm():
    section = lambda i, b: bytes([i, len(b)]) + b
    return b"\0asm\x01\0\0\0" + section(1, b"\x01\x60\x02\x7f\x7f\x01\x7f") + section(3, b"\x01\x00") + section(7, b"\x01\x03add\x00\x00") + section(10, b"\x01\x07\x00\x20\x00\x20\x01\x6a\x0b")


def formats():
    return {
        "PNG": (png(), lambda v: [c["tag"] for c in v["chunks"]] == ["IHDR", "IDAT", "IEND"] and v["chunks"][0]["data"]["color"] == (6, "rgb_alpha")),
        "GZIP": (b"\x1f\x8b\x08\x08" + bytes(6) + b"f.txt\0", lambda v: v["file_name"] == "f.txt" and "note" not in v),
        "ZIP": (zipped(), lambda v: [e["name"] for e in v["entries"]] == ["hello"] and v["directory"][0]["name"] == "hello" and v["end"]["total"] == 1),
        "ELF": (elf(), lambda v: v["machine"] == (62, "x86_64") and v["segments"][0]["kind"] == (1, "load") and v["sections"][0]["kind"] == (1, "progbits")),
        "PE": (pe(), lambda v: v["headers"]["optional"]["base32"] == 9 and v["headers"]["sections"][0]["name"] == ".text"),
        "Mach-O": (struct.pack("<8I", 0xFEEDFACF, 0x0100000C, 0, 2, 0, 0, 0, 0), lambda v: v["cpu"][1] == "arm64" and v["kind"][1] == "execute"),
        "PCAP": (struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1, 2, 4, 60) + b"abcd", lambda v: v["link"][1] == "ethernet" and v["packets"][0]["data"] == b"abcd"),
        "SQLite": (b"SQLite format 3\0" + struct.pack(">H6B", 4096, 1, 1, 0, 64, 32, 32) + bytes(32) + struct.pack(">I", 1) + bytes(40), lambda v: v["title"] == "SQLite format 3" and v["page_size"] == 4096 and v["encoding"][1] == "utf8"),
        "WASM": (wasm(), lambda v: v["sections"][2]["content"]["items"][0]["name"] == "add"),
        "GIF": (b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0b10110101, 0, 0), lambda v: (v["width"], v["height"]) == (3, 2)),
    }


@pytest.mark.parametrize("name", ["PNG", "GZIP", "ZIP", "ELF", "PE", "Mach-O", "PCAP", "SQLite", "WASM", "GIF"])
def test_built_in_formats(name):
    text = built_in()[name]
    entry, endian = P.entry_of(text, None, None)
    data, good = formats()[name]
    o = P.program(text).run(data, entry, endian)
    assert o.fault is None and good(values(o.tree)) and P.count_failed(o.tree) == 0


def test_gunzip_as_module():
    text = built_in()["WASM"]
    o = P.program(text).run(gzip.compress(wasm()), "Packed", "le")
    rows = P.flatten(o.tree)
    assert o.fault is None and any(r["v_str"] == "add" and r["space_id"] == 1 and r["path"].startswith("Packed.module.sections[2]") for r in rows)


def test_tables_and_modes(spark):
    objects = spark.createDataFrame([("a", b"\x01\x02\x00\x03\x00"), ("b", b"\x02\x02"), ("c", None)], "object_id string, content binary")
    text = "struct S { n u8 xs u16[n] rest bytes[*] }"
    o = P.parse(objects, text, render=True).collect()
    by = {r.object_id: r for r in o}
    assert by["a"].fault is None and by["a"].coverage.covered == 5 and by["b"].fault.path == "S.xs[0]" and by["c"].fault.offset == 0
    assert json.loads(by["a"].json)["tree"]["children"][0]["value"] == {"kind": "u", "value": 1} and "n: u8 = 1  [@0 +1]" in by["a"].tree
    f = P.fields(P.parse(objects, text, paths=["S.xs[]"])).collect()
    assert [(r.object_id, r.path, int(r.v_u)) for r in f] == [("a", "S.xs[0]", 2)]
    with pytest.raises(Exception, match="out_of_bounds"):
        P.parse(objects, text, mode="FAILFAST").collect()
    assert P.parse(objects.limit(0), text).count() == 0


ADMISSIBLE = """
enum E : u16 { a = 1 b = 2 } bitfield B : u8 { x 0 y 1..3 } struct In { p u16 q i8 }
struct S { k u8 e E b B t string[3] w u32be v i16 in In far at 2 u16 half u8 if b.x n = k % 4 + 1 run u8[n] big u64 sum u8 check sum8 over(k .. t) more In[2] tail repeat In }
"""


@given(st.binary(min_size=0, max_size=60))
@settings(max_examples=25, deadline=None)
def test_compiled_equals_interpreted(data):
    DATA.append(data)


DATA: list[bytes] = []


def test_tiers_agree(spark):
    """What hypothesis drew above, all in one job."""
    data = list(dict.fromkeys([*DATA, bytes(range(60)), b"\x03" * 39]))
    rows = spark.createDataFrame(list(enumerate(data)), "i int, content binary").select("i", compiled(F.col("content"), ADMISSIBLE, "S").alias("r")).collect()
    for row in rows:
        o = run(ADMISSIBLE, data[row.i])
        v, r = values(o.tree), row.r
        assert r["_ok"] == (o.fault is None), data[row.i]
        for name, want in v.items():
            got = r[name]
            if name == "e":
                assert (got.value, got.name) == want
            elif name == "b":
                assert (got.x, got.y) == tuple(c.value for c in o.tree.child("b").children)
            elif name == "in":
                assert o.fault or (got.p, got.q) == (want["p"], want["q"])
            elif name in ("more", "tail"):
                assert o.fault or [(x.p, x.q) for x in got] == [(x["p"], x["q"]) for x in want]
            elif name == "run":
                assert o.fault or list(got) == want
            elif name == "sum":
                assert (got.stored, got.ok) == (want, o.tree.child("sum").check["ok"])
            else:
                assert got == want, (name, data[row.i])


def test_not_admissible(spark):
    for text in ("struct S { a varint }", "struct S { a bytes[*] decode base64 }", "struct S { a repeat u8 while 1 }"):
        with pytest.raises(NotAdmissible):
            compiled(F.lit(b""), text, "S")


FIXED = """
// @entry S
enum E : u16 { a = 1 b = 2 big = 65535 } enum N : i8 { high = 255 one = 1 }
bitfield B : u32 { x 0 y 1..3 z 8..31 } struct In { p u16 q i8be_ } struct Empty { }
struct S {
    k u8 "the key" t u16be e E n N b B s string[5] c char cs char[3] raw bytes[4] f f32 g f64be on bool in In none Empty more In[2] nums u16[3] no u8[0]
    big u64 more_ i64be twice = k * 2 - 300 deep = in.p + more_ - 1 wrap = big * big + 7 sum u8 check sum8 over(k .. t) crc u32be check crc32 over(e .. raw)
}
""".replace("i8be_", "i8")


@pytest.mark.parametrize("order", ["le", "be"])
def test_fixed_layouts_equal_the_interpreter(spark, order):
    """Random objects, some too short, some longer: the same rows as from the interpreter alone."""
    import random

    from bytesmith.plans import fixed

    rng = random.Random(7)
    stride = fixed.plan(parse_schema(FIXED), "S", order)[0].size
    data = [rng.randbytes(rng.choice([0, 3, stride - 1, stride, stride, stride, stride + 9])) for _ in range(300)]
    data += [b"AB\0C\xff" * 40, bytes(stride), b"\xff" * stride]
    for i in range(0, len(data), 5):
        if len(data[i]) >= stride:
            at = next(s for s in fixed.plan(parse_schema(FIXED), "S", order) if s.name == "sum").offset
            data[i] = data[i][:at] + bytes([sum(data[i][:3]) % 256]) + data[i][at + 1 :]
    objects = spark.createDataFrame([(str(i), d) for i, d in enumerate(data)] + [("null", None)], "object_id string, content binary")
    for paths in (None, ["S.k", "S.more[].q", "S.b.y", "S.wrap", "S.crc"]):
        got = {r.object_id: r for r in P.parse(objects, FIXED, endian=order, paths=paths).collect()}
        assert len(got) == len(data) + 1
        for i, d in enumerate(data):
            o = P.program(FIXED).run(d, "S", order)
            want = [dict(zip([f.name for f in P._FIELD], x)) for x in P.flat_rows(o.tree, None if paths is None else frozenset(paths))]
            mine = [f.asDict(recursive=True) for f in got[str(i)].fields]
            assert len(mine) == len(want)
            for a, b in zip(mine, want):
                a = {k: (int(v) if k == "v_u" and v is not None else bytes(v) if isinstance(v, bytearray) else {x: int(y) if x in ("computed", "stored") else y for x, y in v.items()} if k == "check" and v else v) for k, v in a.items()}
                assert str(a) == str(b), (i, a["path"])
            assert (got[str(i)].fault is None) == (o.fault is None) and got[str(i)].failed_checks == P.count_failed(o.tree)
            assert got[str(i)].coverage.asDict(recursive=True) == coverage_of(leaf_spans(o.tree), len(d))


def test_varying_layouts_are_not_fixed():
    from bytesmith.plans import fixed

    for text in ("struct S { a u8 b u8[a] }", "struct S { a u8 if a }", "struct S { a at 4 u8 }", "struct S { a repeat u8 }", "struct S { a varint }", "struct S { a cstring }", "struct S { a bytes[*] }", "struct S { a u8 b = a / 2 }", "struct S { a S }", "struct S { a bytes[2] decode add(1) }", "struct S { a Nope }", "struct S { a u8[600] }"):
        assert fixed.plan(parse_schema(text), "S", "le") is None
