import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytesmith.functions import bytes as B
from bytesmith.operators import analysis, checks, detect, diff, edit, search, spans
from bytesmith.operators.parse import fields, parse
from bytesmith.sources import catalog, objects
from bytesmith.streaming.parse import faults_by_window, file_stream, parse_stream


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=80, deadline=None)
def test_diff_covers_exactly_the_changes(a, b):
    runs, changed = diff.changed_runs(a, b)
    marked = {i for o, n in runs for i in range(o, o + n)}
    assert marked == {i for i in range(min(len(a), len(b))) if a[i] != b[i]} and changed == len(marked)
    assert all(x[0] + x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_strings():
    assert analysis.find_strings(b"\0\1Name!\0\2ab") == [(2, 5, "ascii", "Name!")]
    wide = "Name".encode("utf-16-le")
    assert analysis.find_strings(b"\x01" + wide + b"\x01\x01") == [(1, 8, "utf16le", "Name")]
    assert [h[2] for h in analysis.find_strings(b"\x01\x01" + "Name".encode("utf-16-be") + b"\x01")] == ["utf16be"]
    assert analysis.find_strings(b"") == []


def test_entropy():
    assert max(analysis.entropies(b"A" * 1000, 4)) == 0 and min(analysis.entropies(bytes(range(256)) * 8, 1)) == pytest.approx(1)
    low_high = analysis.entropies(bytes(4096) + bytes(7 * i % 256 for i in range(4096)), 2)
    assert low_high[0] == 0 and low_high[1] == pytest.approx(1) and analysis.entropies(b"", 4) == [] and len(analysis.entropies(b"ab", 9)) == 2


def test_guesses():
    labels = lambda d: [g[0] for g in analysis.guesses(d)]
    assert analysis.guesses(struct.pack("<I", 1_700_000_000))[0] == ("unix seconds u32 little", "2023-11-14 22:13:20")
    assert "unix milliseconds u64 little" in labels(struct.pack("<Q", 1_700_000_000_000))
    assert "windows filetime u64 little" in labels(struct.pack("<Q", (1_700_000_000 + 11_644_473_600) * 10_000_000))
    assert "dos date" in labels(struct.pack("<I", 0x576EB1AA)) and "uuid v4" in labels(bytes.fromhex("f47ac10b58cc4372a5670e02b2c3d479"))
    assert labels(struct.pack("<I", 42)) == [] and labels(b"\xff" * 4) == []


def test_hints():
    label = lambda d, **k: [h[0] for h in analysis.hints(d, **k)]
    assert label(b"\xff" * 64) == ["fill"] and label(struct.pack("<I", 4) + b"abcd")[0] == "size prefix" and label(bytes(4)) == ["size prefix"]
    assert "offset table" in label(struct.pack("<5I", 16, 20, 33, 40, 50) + bytes(range(40)))
    assert "string pool" in label(b"alpha\0beta\0gamma\0delta\0")
    assert "records" in label(b"".join(struct.pack("<IHH8s", 0xABCD1234, i, 7, b"constant") for i in range(40)))
    x, noise = 1, bytearray()
    for _ in range(4096):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        noise.append(x >> 16 & 255)
    assert "records" not in label(bytes(noise)) and label(b"") == []


def test_needles():
    assert B.hex_needle("50 4b\n03") == b"PK\x03" and B.integer_needle("-1", 2) == b"\xff\xff" and B.integer_needle("0x0102", 2, True) == b"\1\2" and B.needle("utf16", "a") == b"a\0"
    assert B.hex_needle("", empty=True) == b"" and B.hex_needle("0xFF", prefix=True) == b"\xff"
    for bad in (lambda: B.hex_needle(""), lambda: B.hex_needle("abc"), lambda: B.hex_needle("0xFF"), lambda: B.integer_needle("256", 1), lambda: B.integer_needle("x", 1), lambda: B.integer_needle("1", 3)):
        with pytest.raises(B.NeedleError):
            bad()


def test_search(spark):
    assert search.offsets_of(b"aaaa", b"aa") == [0, 1, 2] and search.offsets_of(b"aaaa", b"aa", 2) == [0, 1] and search.offsets_of(b"a", b"") == []
    o = spark.createDataFrame([("x", b"\xff\x00abab\xc3"), ("y", None), ("z", b"")], "object_id string, content binary")
    hits = search.find_all(o, b"ab")
    assert sorted(map(tuple, hits.collect())) == [("x", 2), ("x", 4)] and search.find_all(o, b"").count() == 0
    assert search.before(hits, 4).collect()[0].offset == 2 and search.after(hits, 3).collect()[0].offset == 4
    assert [r[0] for r in o.select(B.find_from(F.col("content"), b"ab", 3)).collect()] == [4, None, None]
    needles = spark.createDataFrame([(1, b"ab"), (2, b"ab"), (3, b""), (4, b"\xc3")], "needle_id long, needle binary")
    assert sorted(map(tuple, search.find_many(o, needles).collect())) == [("x", 1, 2), ("x", 1, 4), ("x", 2, 2), ("x", 2, 4), ("x", 4, 6)]


def test_reads(spark):
    data = struct.pack("<fd", -1.5, 1e-300) + b"\xff\xfe"
    r = spark.createDataFrame([(data,)], "c binary").select(
        B.float_value(F.col("c"), 0, 4, False), B.float_value(F.col("c"), 4, 8, False), B.signed(F.col("c"), 12, 2, False), B.unsigned(F.col("c"), 13, 2, True), B.signed(F.col("c"), 6, 8, True), B.window(F.col("c"), 12, 99), B.window(F.col("c"), 99, 9)
    ).first()
    assert list(r)[:4] == [-1.5, 1e-300, -257, None] and r[4] == int.from_bytes(data[6:14], "big", signed=True) and bytes(r[5]) == b"\xff\xfe" and bytes(r[6]) == b""
    for v in (float("inf"), 0.0, 5e-324, 1.7976931348623157e308, float("nan")):
        got = spark.createDataFrame([(struct.pack(">d", v),)], "c binary").select(B.float_value(F.col("c"), 0, 8, True)).first()[0]
        assert got == v or (np.isnan(v) and np.isnan(got))


def test_strict_text(spark):
    rows = spark.createDataFrame([(b"abc",), (b"a\xff",), ("é€".encode(),), (b"a\0\x00\xd8",), (b"=\xd8\x00\xde",), (b"a",)], "c binary")
    got = rows.select(*[B.strict_text(F.col("c"), e) for e in ("ascii", "utf8", "utf16le")]).collect()
    assert [tuple(x is not None for x in r) for r in got] == [(True, True, False), (False, False, True), (False, True, False), (False, False, False), (False, False, True), (True, True, False)]


def test_detect(spark):
    rows = [("png", b"\x89PNG\r\n\x1a\n"), ("wav", b"RIFF\0\0\0\0WAVE"), ("riff", b"RIFF\0\0\0\0NONE"), ("tar", bytes(257) + b"ustar"), ("cafe", b"\xca\xfe\xba\xbe"), ("short", b"\x89P"), ("none", None)]
    found = detect.best_first(detect.detect(spark.createDataFrame(rows, "object_id string, content binary"))).orderBy("object_id", "rank").collect()
    assert [(r.object_id, r.format, r.rank) for r in found] == [("cafe", "Mach-O fat", 1), ("cafe", "Java class", 2), ("png", "PNG", 1), ("tar", "TAR", 1), ("wav", "WAV", 1)]


def test_plugins(spark, tmp_path):
    schema = "// @entry G\nstruct G { sig char[3] }\n"
    text = catalog.export_pack("My Format!", schema, confidence=99, detect=((0, "47 49"), (2, "46")))
    folder = catalog.PluginFolder(tmp_path / "p")
    plugin = folder.install(text)
    assert plugin.id == "my-format" and plugin.formats[0].schema == schema and plugin.formats[0].entry == "G"
    o = spark.createDataFrame([("g", b"GIF89a")], "object_id string, content binary")
    both = detect.registry() + catalog.plugin_signatures(folder.list())
    assert [r.format for r in detect.best_first(detect.detect(o, both)).orderBy("rank").collect()] == ["GIF", "My Format!"]
    with_schema = detect.with_schema(detect.detect(o, both), catalog.schema_table(spark, folder.list())).collect()
    assert [(r.format, r.source) for r in with_schema] == [("GIF", "built-in")]
    folder.enable("my-format", False)
    assert not folder.list()[0].enabled and catalog.plugin_signatures(folder.list()) == []
    (tmp_path / "p" / "bad.toml").write_text("id = ")
    assert any(p.error for p in folder.list())
    folder.install(text)
    assert [p.enabled for p in folder.list() if p.id == "my-format"] == [True]
    folder.remove("my-format")
    for bad in ("../x", "a/b", ""):
        with pytest.raises(catalog.CatalogError):
            folder.enable(bad, False)
    with pytest.raises(catalog.CatalogError):
        catalog.export_pack("x", schema, confidence=101)
    assert catalog.PluginFormat("n", "s", detect=((0, "zz"),)).rules() is None and catalog.registry_path("a/b.toml") == "a/b.toml"


def test_library(tmp_path):
    lib = catalog.Library(tmp_path)
    assert lib.add("Zed Format", "struct S { }") == "zed-format" and lib.add("alpha", "struct S { }") == "alpha"
    assert [i for i, _ in lib.list()] == ["alpha", "zed-format"] and "@name Zed Format" in lib.load("zed-format")
    lib.remove("alpha")
    with pytest.raises(catalog.CatalogError):
        lib.load("alpha")
    assert ("user", "zed-format", "Zed Format") in catalog.listing(lib)


def test_edits(spark):
    over = edit.Overlay(5)
    assert over.set(1, b"XY") and over.set(2, b"Z") and not over.set(4, b"ab") and over.set(0, b"")
    assert over.apply(b"abcde") == b"aXZde" and over.undo() and over.apply(b"abcde") == b"aXYde" and over.redo() and over.apply(b"abcde") == b"aXZde"
    over.undo()
    over.set(0, b"q")
    assert not over.redo() and sorted(over.bytes) == [0, 1, 2]
    over.clear()
    assert not over.undo() and over.apply(b"abcde") == b"abcde"
    big = edit.encode_value
    assert big("u", 2, True, "0x102") == b"\1\2" and big("i", 1, False, "-1") == b"\xff" and big("f", 4, False, "1.5") == struct.pack("<f", 1.5) and big("bool", 4, False, "TRUE") == b"\1"
    assert big("str", 4, False, " ab ") == b"ab\0\0" and big("bytes", 3, False, "0xff") == b"\xff\0\0" and big("char", 1, False, "é") == b"\xe9"
    for bad in (("u", 1, "256"), ("i", 1, "128"), ("str", 1, "ab"), ("bool", 1, "2"), ("char", 1, "ab"), ("f", 3, "1"), ("x", 1, "1"), ("bytes", 1, "abc")):
        with pytest.raises(edit.EncodeError):
            big(bad[0], bad[1], False, bad[2])


def test_field_edits_and_repair(spark):
    text = "struct S { a u16be b u16 inner bytes[2] sum u8 check sum8 over(a .. inner) all u16be check crc16 over(a .. sum) }"
    o = spark.createDataFrame([("x", bytes(9))], "object_id string, content binary")
    changes = spark.createDataFrame([("x", "S.a", "258"), ("x", "S.b", "1"), ("x", "S.inner", "ff")], "object_id string, path string, text string")
    log = edit.field_edits(fields(parse(o, text)), changes)
    assert sorted((r.offset, bytes(r.bytes)) for r in log.collect()) == [(0, b"\1\2"), (2, b"\1\0"), (4, b"\xff\0")]
    edited = edit.overlay_sets(o, log.withColumn("seq", F.col("offset")))
    fixed = edit.fix_checksums(edited, text).first()
    assert (fixed.fixed, fixed.remaining) == (3, 0)  # the second sum covers the first, so it is written twice
    assert checks.verdicts(fields(parse(edited.select("object_id", F.lit(bytes(fixed.content)).alias("content")), text))).filter("NOT ok").count() == 0


def test_span_joins(spark):
    rng = np.random.default_rng(3)
    a = [("o", int(x), int(n)) for x, n in zip(rng.integers(0, 500, 60), rng.integers(1, 90, 60))]
    b = [("o", int(x), int(n)) for x, n in zip(rng.integers(0, 500, 40), rng.integers(1, 50, 40))]
    left, right = (spark.createDataFrame(x, "object_id string, offset long, size long") for x in (a, b))
    want = sum(1 for x in a for y in b if x[1] < y[1] + y[2] and y[1] < x[1] + x[2])
    assert spans.overlaps(left, right, 16).count() == want
    covered = {i for x in a for i in range(x[1], x[1] + x[2])}
    got = spans.islands(left).collect()
    assert {i for r in got for i in range(r.offset, r.offset + r["size"])} == covered and sum(r["size"] for r in got) == len(covered)
    gaps = spans.uncovered(left, spark.createDataFrame([("o", 700), ("empty", 5)], "object_id string, total long")).collect()
    assert {i for r in gaps if r.object_id == "o" for i in range(r.offset, r.offset + r.len)} == set(range(700)) - covered and [(r.offset, r.len) for r in gaps if r.object_id == "empty"] == [(0, 5)]
    g = spark.createDataFrame([("o", 10, 2), ("o", 50, 9)], "object_id string, offset long, len long")
    p = spark.createDataFrame([("o", 10), ("o", 60), ("o", 0)], "object_id string, at long")
    assert {r["at"]: r.gap_offset for r in spans.gap_after(p, g).collect()} == {10: 50, 60: 10, 0: 10} and spans.largest_gaps(g, 1).first().offset == 50


def test_next_change_is_strict(spark):
    runs = spark.createDataFrame([("o", 5), ("o", 9)], "object_id string, offset long")
    points = spark.createDataFrame([("o", x) for x in (0, 5, 7, 9, 10)], "object_id string, at long")
    got = {r["at"]: (r.next, r.previous) for r in diff.next_change(runs, points).collect()}
    assert got == {0: (5, None), 5: (9, None), 7: (9, 5), 9: (None, 5), 10: (None, 9)}


def test_tree_diff(spark):
    text = "struct I { a u8 b u8 } struct S { n u8 xs I[n] }"
    tree = lambda d: fields(parse(spark.createDataFrame([("o", d)], "object_id string, content binary"), text, entry="S"))
    got = {r.path: r.status for r in diff.tree_diff(tree(b"\x02abcd"), tree(b"\x02abcX")).collect()}
    assert {p for p, s in got.items() if s == "changed"} == {"S", "S.xs", "S.xs[1]", "S.xs[1].b"}
    got = {r.path: r.status for r in diff.tree_diff(tree(b"\x02abcd"), tree(b"\x01ab")).collect()}
    assert got["S.xs[1].a"] == "gone" and got["S.xs[0].a"] == "same" and got["S.xs"] == "changed"


def test_tree_diff_of_pairs_equals_joined_fields(spark):
    """A fixed and a varying layout, short and absent contents, values that only look different or only look alike; with and without paths."""
    fixed_text = "enum E : u8 { a = 1 } bitfield B : u8 { low 0 .. 3 top 7 } struct Q { d u8 t string[3] } struct S { f f32 flag bool q Q e E b B xs u16[2] n = flag + 1 }"
    whole = struct.pack("<f?B3sBBHH", 1.5, True, 7, b"abc", 1, 0x83, 5, 6)
    at = lambda n, x: whole[:n] + x + whole[n + len(x) :]
    nan = at(0, b"\0\0\xc0\x7f")
    edits = [
        (whole, whole), (nan, at(0, b"\1\0\xc0\x7f")), (at(0, bytes(4)), at(0, b"\0\0\0\x80")), (whole, nan), (whole, at(4, b"\2")), (whole, at(4, b"\0")), (at(6, b"\xff"), at(6, b"\xfe")), (whole, at(7, b"x")), (whole, at(9, b"\2")),
        (whole, at(10, b"\x03")), (whole, at(10, b"\x93")), (whole, at(13, b"\1")), (whole, whole + b"!"), (whole, whole[:8]), (whole[:8], whole), (whole[:5], at(5, b"\1")[:6]), (None, whole), (whole, None), (b"", None),
    ]
    varying = [(b"\x02abcd", b"\x02abcX"), (b"\x02abcd", b"\x01ab"), (b"\x01ab", b"\x02abcd"), (b"\x02abc", b"\x02abcd"), (None, b"\x00")]
    for text, cases, some in ((fixed_text, edits, ["S", "S.q.t", "S.xs[]", "S.b"]), ("struct I { a u8 b u8 } struct S { n u8 xs I[n] }", varying, ["S", "S.xs[].b"])):
        pairs = spark.createDataFrame([(f"o{i}", *x) for i, x in enumerate(cases)], "object_id string, left binary, right binary")
        for paths in (None, some):
            tree = lambda side: fields(parse(pairs.select("object_id", F.col(side).alias("content")), text, entry="S", paths=paths))
            want = sorted(map(tuple, diff.tree_diff(tree("left"), tree("right")).collect()))
            assert sorted(map(tuple, diff.tree_diff_of(pairs, text, entry="S", paths=paths).collect())) == want and {r[3] for r in want} == {"same", "changed", "gone"}


def test_deepest_of_equals_joined_points(spark):
    """A fixed and a varying layout, pointers, short and absent contents, places outside, none, null and repeated."""
    fixed_text = "struct Q { d u8 t string[3] } struct S { a u16 q Q xs u16[20] n = a + 1 z u8 }"
    pointed = "struct T { x u16 y u16 } struct S { n u8 place u8 far at place T xs T[n] }"
    places = [list(range(-2, 60)), [5, 5, None], [], None, [2**40, 0, -(2**40)]]
    for text, contents in ((fixed_text, [bytes(range(47)), bytes(80), bytes(46), b"", None]), (pointed, [b"\x02\x0a" + bytes(30), b"\x01\x1e" + bytes(9), b"\x02", None])):
        o = spark.createDataFrame([(f"o{i}-{j}", c, at) for i, c in enumerate(contents) for j, at in enumerate(places)], "object_id string, content binary, at array<bigint>")
        want = sorted(map(tuple, spans.deepest(o.select("object_id", F.explode("at").alias("at")), parse(o.select("object_id", "content"), text, entry="S")).collect()))
        assert sorted(map(tuple, spans.deepest_of(o, text, entry="S").collect())) == want and len({r[3] for r in want}) > 4


def test_files_heads_and_save(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"A" * 5000)
    o = objects.files(spark, str(tmp_path / "in"))
    assert objects.pages(o).count() == 2 and bytes(objects.heads(spark, str(tmp_path / "in"), 3).first().content) == b"AAA"
    out = f"file://{tmp_path}/out"
    first = objects.save(o, out).collect()
    again = objects.save(objects.region(o, 1, 2), out).collect()
    assert (first[0].bytes, first[0].backed_up, again[0].backed_up) == (5000, False, True)
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"AA" and len((tmp_path / "out" / "a.bin.bak").read_bytes()) == 5000
    row = objects.hex_rows(objects.pages(objects.region(o, 0, 20))).orderBy("offset").collect()[1]
    assert (row.offset, row.hex, row.ascii) == (16, "41 41 41 41", "AAAA")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.bin").write_bytes(bytes([i, 1, 2][: i + 1]))
    text = "struct S { a u8 b u16 }"
    q = parse_stream(file_stream(spark, str(tmp_path / "in"), "*.bin"), text).select("object_id", "fault.path").writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = parse(objects.files(spark, str(tmp_path / "in")), text).select("object_id", "fault.path")
    assert sorted(map(tuple, spark.table("parsed").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    events = spark.createDataFrame([(time.time(), "a")] * 3, "t double, kind string").select(F.timestamp_seconds("t").alias("ts"), "kind")
    assert faults_by_window(events).first().n == 3


def test_limits_and_candidates(spark):
    s = analysis.strings(spark.createDataFrame([("a", b"one1\0two2\0three"), ("b", b"")], "object_id string, content binary"))
    got = analysis.limited(s, 2, [F.col("offset")]).collect()
    assert [(r.text, r.total_rows, r.truncated) for r in got] == [("one1", 3, True), ("two2", 3, True)]


def test_field_at_by_brute_force():
    """Random nestings, some with places outside the root: the first child that holds the place, or else the smallest field."""
    import random

    from bytesmith.operators.spans import Tree

    rng = random.Random(5)
    for _ in range(200):
        nodes = [(0, None, 0, rng.randrange(1, 40))]
        for i in range(1, rng.randrange(2, 60)):
            a = rng.randrange(60)
            nodes.append((i, rng.randrange(i), a, a + rng.randrange(12)))
        tree = Tree(*(list(c) for c in zip(*nodes)))
        for at in range(70):
            holds = lambda n: nodes[n][2] <= at < nodes[n][3]
            want = 0 if holds(0) else None
            if want == 0:
                while (inner := next((n for n in range(len(nodes)) if nodes[n][1] == want and holds(n)), None)) is not None:
                    want = inner
            else:
                want = min((n for n in range(len(nodes)) if holds(n)), key=lambda n: nodes[n][3] - nodes[n][2], default=None)
            assert tree.field_at(at) == want
    wide = Tree([0, *range(1, 101)], [None, *[0] * 100], [0, *range(0, 200, 2)], [200, *range(1, 201, 2)])
    assert wide.field_at(50) == 26 and wide.field_at(51) == 0


def test_many_needles_in_shards(spark):
    """The same hits from one automaton as from several."""
    from bytesmith.operators.search import find_many

    objects = spark.createDataFrame([(str(i), f"a{i} bc ab{i % 7} needle".encode()) for i in range(50)] + [("none", None)], "object_id string, content binary")
    needles = spark.createDataFrame([(i, w.encode()) for i, w in enumerate(["a", "ab", "bc a", "needle", "dle", "", "zz", "ab", "3 "])], "needle_id long, needle binary")
    one = sorted(map(tuple, find_many(objects, needles).collect()))
    assert one == sorted(map(tuple, find_many(objects, needles, shard_bytes=200).collect())) and len({r[1] for r in one}) == 7
