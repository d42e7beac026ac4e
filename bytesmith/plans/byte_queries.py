"""More registered queries, each beside the SQL for it: the layout language's forms, the built-in formats, readings, needles, hints, plugins, edits."""

from __future__ import annotations

import gzip
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import tables
from ..functions.checksums import CRC16, checksum_column
from ..operators import analysis, checks, detect, edit, parse, search, spans
from ..sources import catalog
from ..sources import objects as O
from . import compile as tier_a
from . import samples
from .editing import insert_fields, validate
from .oracles import DOCS, SPANS, _best_formats  # noqa: F401
from .queries import HEADED, be, documents, line_spans, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def le(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(width, 0, -1)]))


def utf8(c: str | Column) -> Column:
    return F.encode(c, "UTF-8")


def number(c: str) -> Column:
    return F.col(c).cast("bigint")


# readings

@query(f"WITH {DOCS} SELECT doc_id, substr(h, 2 * (doc_id % 700) + 1, 2 * (doc_id % 90)) AS hex FROM d")
def src_window(spark, sf_dir):
    """Windows at varying places, cut at each object's end."""
    k = number("object_id")
    return documents(spark, sf_dir).select(k.alias("doc_id"), F.hex(B.window(F.col("content"), k % 700, k % 90)).alias("hex"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS line, l_extendedprice AS a, l_quantity AS b, -l_quantity / 4 AS c, l_tax - 0.5 AS d FROM lineitem")
def src_floats(spark, sf_dir):
    """Floats of both widths and orders, packed here and read by compiled expressions."""

    @F.arrow_udf("binary")
    def pack(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        import numpy as np

        kinds = np.dtype([("a", ">f8"), ("b", "<f4"), ("c", ">f4"), ("d", "<f8")])
        out = np.empty(len(a), kinds)
        for name, x in zip("abcd", (a, b, c, d)):
            out[name] = x.to_numpy(zero_copy_only=False)
        return pa.array([r.tobytes() for r in out], pa.binary())

    t = table(spark, sf_dir, "lineitem")
    objects = t.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("line"), pack("l_extendedprice", "l_quantity", -F.col("l_quantity") / 4, F.col("l_tax") - 0.5).alias("content"))
    r = tier_a.compiled(F.col("content"), "struct X { a f64be b f32le c f32be d f64 }", "X")
    return objects.select("l_orderkey", "l_partkey", "l_suppkey", "line", r.alias("r")).select("l_orderkey", "l_partkey", "l_suppkey", "line", "r.a", "r.b", "r.c", "r.d")


@query(f"""WITH {DOCS}, r AS (SELECT doc_id, unnest(range((octet_length(b) + 15) // 16)) AS i, h FROM d), x AS (SELECT doc_id, i * 16 AS "offset", substr(h, 32 * i + 1, 32) AS x FROM r)
    SELECT doc_id, "offset", trim(regexp_replace(x, '(..)', '\\1 ', 'g')) AS hex,
        array_to_string(list_transform(regexp_extract_all(x, '..'), lambda p: CASE WHEN p BETWEEN '20' AND '7E' THEN chr(('0x' || p)::INTEGER) ELSE '.' END), '') AS ascii FROM x""")
def src_hex_rows(spark, sf_dir):
    """The rows of a hex view of each document."""
    return O.hex_rows(O.pages(documents(spark, sf_dir))).select(number("object_id").alias("doc_id"), "offset", "hex", "ascii")


@query(f"WITH {DOCS}, w AS (SELECT doc_id, unhex(substr(h, 2 * (doc_id % 50) + 1, 80)) AS b FROM d) SELECT doc_id, try(decode(b)) IS NOT NULL AS whole, try(decode(b)) AS text FROM w")
def src_utf8(spark, sf_dir):
    """Windows that may cut a character: the text where they are valid UTF-8."""
    k = number("object_id")
    text = B.strict_text(B.window(F.col("content"), k % 50, 40), "utf8")
    return documents(spark, sf_dir).select(k.alias("doc_id"), text.isNotNull().alias("whole"), text.alias("text"))


@query("SELECT n_name || '.bin' AS name, length(n_name)::BIGINT + 2 AS length, hex(encode('v2' || n_name)) AS hex, upper(hex(encode('v2' || n_name))[1:12]) AS head, hex(encode('v1' || n_name)) AS backup FROM nation")
def src_files(spark, sf_dir):
    """Objects saved as files, saved again with a backup, and read: whole, their heads, and the backups."""
    folder = f"{O.shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"
    n = table(spark, sf_dir, "nation")
    for version in ("v1", "v2"):
        O.save(n.select(F.concat("n_name", F.lit(".bin")).alias("object_id"), utf8(F.concat(F.lit(version), "n_name")).alias("content")), folder).count()
    name = F.element_at(F.split("object_id", "/"), -1)
    whole = O.files(spark, folder, "*.bin").select(name.alias("name"), F.col("length"), F.hex("content").alias("hex"))
    head = O.heads(spark, f"{folder}/*.bin", 6).select(name.alias("name"), F.hex("content").alias("head"))
    old = O.files(spark, folder, "*.bak").select(F.regexp_replace(name, r"\.bak$", "").alias("name"), F.hex("content").alias("backup"))
    return whole.join(head, "name").join(old, "name")


# the layout language's forms

def items(spark: SparkSession, sf_dir: str, item: Column, first: Column, last: Column) -> DataFrame:
    """An object per order: `first`, the items of its lines in a fixed order, `last`."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    each = F.transform("x", lambda x, i: F.hex(item(x, i, F.size("x"))))
    return lines.select(F.col("l_orderkey").cast("string").alias("object_id"), F.concat(first, F.unhex(F.array_join(each, "")), last).alias("content"))


def told(objects: DataFrame, schema: str) -> DataFrame:
    """Per object: how many items, the sum of their parts, what the tail holds, and whether all was read."""
    o = parse.parse(objects, schema, paths=["Order.items[].part", "Order.tail"], covered=False)
    parts = F.filter("fields", lambda f: f["name"] == "part")
    tail = F.get(F.filter("fields", lambda f: f["name"] == "tail"), F.lit(0))["v_bytes"]
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, f: a + f["v_u"].cast("bigint"))
    return o.select(number("object_id").alias("l_orderkey"), F.size(parts).cast("bigint").alias("n"), total.alias("parts"), F.hex(tail).alias("tail"), F.col("fault").isNull().alias("whole"))


def told_sql(tail: str) -> str:
    return f"SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts, {tail} AS tail, true AS whole FROM lineitem GROUP BY l_orderkey"


def plain_item(x: Column, i: Column, n: Column) -> Column:
    return F.concat(be(x["l_partkey"], 4), be(F.when(i == n - 1, 1).otherwise(0), 1))


ITEM = "// @entry Order\nstruct Item { part u32be last u8 } "


@query(told_sql("NULL::VARCHAR"))
def prj_repeat_to_end(spark, sf_dir):
    return told(items(spark, sf_dir, plain_item, be(F.col("l_orderkey"), 4), F.lit(b"")), ITEM + "struct Order { key u32be items repeat Item }")


@query(told_sql("'0000000901' || '5441494C'"))
def prj_repeat_until(spark, sf_dir):
    """The item that meets the condition is the last one; what looks like a further item is the tail."""
    return told(items(spark, sf_dir, plain_item, be(F.col("l_orderkey"), 4), F.lit(bytes.fromhex("0000000901") + b"TAIL")), ITEM + "struct Order { key u32be items repeat Item until last == 1 tail bytes[*] }")


@query(told_sql("CASE WHEN l_orderkey % 2 = 0 THEN 'A4A5' ELSE 'A5' END"))
def prj_repeat_while(spark, sf_dir):
    """Items while two bytes stand before them; a tail that has only the first of them is no match."""
    marked = lambda x, i, n: F.concat(F.lit(b"\xa5\x01"), be(x["l_partkey"], 4))
    tail = F.when(F.col("l_orderkey") % 2 == 0, F.lit(b"\xa4\xa5")).otherwise(F.lit(b"\xa5"))
    return told(items(spark, sf_dir, marked, F.lit(b""), tail), "struct Order { items repeat Item while 0xA5 0x01 tail bytes[*] } struct Item { mark bytes[2] part u32be }")


@query(told_sql("'FFFE' || lpad(to_hex(l_orderkey), 8, '0')"))
def prj_repeat_until_bytes(spark, sf_dir):
    """Items up to two bytes, which are left for what follows."""
    return told(items(spark, sf_dir, plain_item, be(F.col("l_orderkey"), 4), F.concat(F.lit(b"\xff\xfe"), be(F.col("l_orderkey"), 4))), ITEM + "struct Order { key u32be items repeat Item until 0xFF 0xFE tail bytes[*] }")


@query("SELECT p_partkey, (p_size % 64)::BIGINT AS size, (p_partkey % 4)::BIGINT AS kind, p_partkey % 2 = 1 AS top, (p_size % 16)::BIGINT AS low, p_size % 64 >= 32 AS high, (p_size % 64)::BIGINT AS compiled FROM part")
def prj_bitfields(spark, sf_dir):
    """Bits of u16 and of u8, by the interpreter and by compiled expressions."""
    k, size = F.col("p_partkey"), (F.col("p_size") % 64).cast("bigint")
    content = F.concat(le(size + (k % 4) * 64 + (k % 2) * 32768, 2), be(size, 1))
    text = "struct P { bits Bits more More } bitfield Bits : u16 { size 0..5 kind 6..7 top 15 } bitfield More : u8 { low 0..3 high 5 }"
    o = table(spark, sf_dir, "part").select(k.cast("string").alias("object_id"), content.alias("content"))
    at = lambda p: F.get(F.filter("fields", lambda f: f["path"] == f"P.{p}"), F.lit(0))
    u = lambda p: at(p)["v_u"].cast("bigint")
    read = parse.parse(o, text, covered=False).select("object_id", u("bits.size").alias("size"), u("bits.kind").alias("kind"), at("bits.top")["v_bool"].alias("top"), u("more.low").alias("low"), at("more.high")["v_bool"].alias("high"))
    other = o.select("object_id", tier_a.compiled(F.col("content"), text, "P").alias("r")).select("object_id", F.col("r.bits.size").cast("bigint").alias("compiled"))
    return read.join(other, "object_id").withColumn("p_partkey", number("object_id")).drop("object_id")


@query("""SELECT s_suppkey, (s_nationkey - 12)::BIGINT AS nation, s_name AS name, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 65536 END AS extra, (2 * s_nationkey - 24)::BIGINT AS twice, s_nationkey > 12 AS up FROM supplier""")
def prj_dotted(spark, sf_dir):
    """Texts up to a NUL, signed varints, and dotted paths in conditions and expressions."""
    s = table(spark, sf_dir, "supplier")
    kind = F.col("s_suppkey") % 3
    signed = (F.col("s_nationkey") - 12).bitwiseAND(127)
    content = F.concat(be(kind, 1), be(signed, 1), utf8("s_name"), F.lit(b"\0"), F.when(kind == 2, le(F.col("s_suppkey") % 65536, 2)).otherwise(F.lit(b"")), F.when(F.col("s_nationkey") > 12, F.lit(b"\x07")).otherwise(F.lit(b"")))
    text = "// @entry S\nstruct Head { kind u8 nation svarint } struct S { head Head name cstring extra u16 if head.kind == 2 twice = head.nation * 2 up u8 if head.nation > 0 }"
    o = parse.parse(s.select(F.col("s_suppkey").cast("string").alias("object_id"), content.alias("content")), text, covered=False)
    at = lambda p: F.get(F.filter("fields", lambda f: f["path"] == f"S.{p}"), F.lit(0))
    whole = lambda p: F.coalesce(at(p)["v_i"], at(p)["v_u"].cast("bigint"))
    return o.select(number("object_id").alias("s_suppkey"), whole("head.nation").alias("nation"), at("name")["v_str"].alias("name"), whole("extra").alias("extra"), whole("twice").alias("twice"), at("up")["v_u"].isNotNull().alias("up"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def prj_failfast(spark, sf_dir):
    """A strict parse, of objects without faults."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), F.concat(be(F.octet_length("c_name"), 1), utf8("c_name")).alias("content"))
    f = parse.fields(parse.parse(c, "struct C { size u8 name string[size] }", mode="FAILFAST", paths=["C.name"]))
    return f.select(number("object_id").alias("c_custkey"), F.col("v_str").alias("name"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'limit' AS kind, 0::BIGINT AS offset, 'S.a.a' AS path FROM nation")
def prj_depth(spark, sf_dir):
    """A struct that holds itself ends in a fault, not in an error."""
    o = parse.parse(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), utf8("n_name").alias("content")), "struct S { a S }", render=True)
    return o.select(number("object_id").alias("n_nationkey"), "fault.kind", "fault.offset", F.regexp_extract("fault.path", r"^(S\.a\.a)(?:\.a)+$", 1).alias("path"))


@query("""SELECT c_custkey, c_name AS a, '2a ' || c_mktsegment AS b FROM customer""")
def ext_table_functions(spark, sf_dir):
    """Fields and strings by table functions, in LATERAL joins."""
    tables.register(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(be(F.octet_length("c_name"), 1), utf8("c_name"), F.lit(b"\x2a\xff\xff"), utf8("c_mktsegment")).alias("content"))
    name = f"byte_objects_{uuid.uuid4().hex[:8]}"
    c.createOrReplaceTempView(name)
    schema = "struct C { size u8 name string[size] star u8 }"
    return spark.sql(f"""SELECT c_custkey, max(CASE WHEN f.path = 'C.name' THEN f.value END) AS a, concat(lower(hex(bigint(max(CASE WHEN f.path = 'C.star' THEN f.value END)))), ' ', max(s.text)) AS b
        FROM {name}, LATERAL parse_fields(content, '{schema}') f, LATERAL find_strings(content, 5) s WHERE s.ordinal = 1 GROUP BY c_custkey""")


# built-in formats

def read_format(spark, sf_dir, make, layout: str, paths: list[str], entry: str | None = None) -> DataFrame:
    """A row per wanted field; the value of a checked one is whether it matches."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), samples.sample(make, F.col("n_nationkey"), F.col("n_name")).alias("content"))
    f = parse.fields(parse.parse(n, catalog.built_in()[layout], entry=entry, mode="FAILFAST", paths=paths))
    shown = F.coalesce(F.col("check.ok").cast("string"), F.col("v_u").cast("string"), F.col("v_i").cast("string"), F.col("v_bool").cast("string"), "v_str", F.col("v_enum.name"), F.hex("v_bytes"))
    return f.select(number("object_id").alias("n_nationkey"), "path", shown.alias("value"))


def format_sql(values: dict[str, str], more: str = "") -> str:
    rows = " UNION ALL ".join(f"SELECT n_nationkey::BIGINT AS n_nationkey, '{p}' AS path, ({v})::VARCHAR AS value FROM nation" for p, v in values.items())
    return rows + more


def built_in_query(name: str, make, layout: str, values: dict[str, str], entry: str | None = None, lists: dict[str, tuple[str, str]] | None = None) -> None:
    """lists: path with {i} -> (SQL for its length, SQL for its i-th value)."""
    lists = lists or {}
    more = "".join(f" UNION ALL SELECT n_nationkey::BIGINT, '{p.split('{i}')[0]}' || i || '{p.split('{i}')[1]}', ({v})::VARCHAR FROM (SELECT *, unnest(range({n})) AS i FROM nation)" for p, (n, v) in lists.items())
    plain = [parse._plain(p) for p in values] + [p.replace("{i}", "") for p in lists]

    def run(spark, sf_dir):
        found = read_format(spark, sf_dir, make, layout, plain, entry)
        return found.filter(F.col("path").isin(*values) | F.col("path").rlike("|".join(["^(?!)"] + ["^" + p.replace("[{i}]", r"\[\d+\]").replace(".", r"\.") + "$" for p in lists])))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, format_sql(values, more)


built_in_query("fmt_png", samples.png, "PNG", {
    "Png.chunks[0].data.width": "100 + n_nationkey", "Png.chunks[0].data.height": "n_nationkey + 1", "Png.chunks[0].data.color": "'rgb_alpha'", "Png.chunks[1].data": "hex(encode(n_name))",
    "Png.chunks[0].crc": "true", "Png.chunks[1].crc": "true", "Png.chunks[2].crc": "true",
}, lists={"Png.chunks[{i}].tag": ("3", "['IHDR', 'IDAT', 'IEND'][i + 1]")})
built_in_query("fmt_gzip", samples.gzipped, "GZIP", {"Member.modified": "1000000000 + n_nationkey", "Member.file_name": "n_name", "Member.flags.has_name": "true", "Member.flags.has_comment": "false", "Member.method": "8"})
built_in_query("fmt_zip", samples.zipped, "ZIP", {"Archive.end.total": "n_nationkey % 3 + 1"}, lists={
    "Archive.entries[{i}].name": ("n_nationkey % 3 + 1", "n_name || '-' || i"), "Archive.entries[{i}].body": ("n_nationkey % 3 + 1", "hex(encode(n_name))"), "Archive.entries[{i}].unpacked": ("n_nationkey % 3 + 1", "length(n_name)"),
    "Archive.directory[{i}].name": ("n_nationkey % 3 + 1", "n_name || '-' || i"),
})
built_in_query("fmt_elf", samples.elf, "ELF", {
    "Elf.entry": "4096 * n_nationkey", "Elf.machine": "'x86_64'", "Elf.kind": "'executable'", "Elf.segments[0].kind": "'load'", "Elf.segments[0].access.write": "false", "Elf.segments[0].access.read": "true",
    "Elf.segments[0].stored": "length(n_name)", "Elf.sections[0].flags.alloc": "true", "Elf.sections[0].flags.write": "false", "Elf.sections[0].size": "n_nationkey",
})
built_in_query("fmt_pe", samples.pe, "PE", {"Image.headers.optional.code_size": "n_nationkey + 3", "Image.headers.optional.base32": "4096 * n_nationkey", "Image.headers.sections[0].name": "n_name[:8]", "Image.headers.sections[0].flags.execute": "true"})
built_in_query("fmt_macho", samples.macho, "Mach-O", {"Header.cpu": "'arm64'", "Header.kind": "'execute'", "Header.command_count": "n_nationkey", "Header.command_size": "length(n_name)"})
built_in_query("fmt_pcap", samples.pcap, "PCAP", {"Capture.zone": "-n_nationkey", "Capture.link": "'ethernet'"}, lists={"Capture.packets[{i}].seconds": ("n_nationkey % 4 + 1", "i"), "Capture.packets[{i}].data": ("n_nationkey % 4 + 1", "hex(encode(n_name))")})
built_in_query("fmt_sqlite", samples.sqlite, "SQLite", {"Database.title": "'SQLite format 3'", "Database.page_size": "1024", "Database.encoding": "'utf8'", "Database.user_version": "n_nationkey", "Database.pages": "2"})
built_in_query("fmt_wasm", samples.wasm, "WASM", {"Module.sections[2].content.items[0].name": "n_name", "Module.sections[2].content.items[0].index": "n_nationkey", "Module.sections[2].content.items[0].kind": "'function'", "Module.sections[0].content.items[0].parameters[1]": "'i32'", "Module.version": "1"})
built_in_query("fmt_wasm_packed", samples.wasm_packed, "WASM", {"Packed.module.sections[2].content.items[0].name": "n_name", "Packed.module.version": "1"}, entry="Packed")
built_in_query("fmt_gif", samples.gif, "GIF", {"Gif.width": "300 + n_nationkey", "Gif.height": "200 + n_nationkey", "Gif.screen.palette_bits": "5", "Gif.screen.sorted": "false", "Gif.screen.depth": "3", "Gif.screen.has_palette": "true", "Gif.background": "n_nationkey"})


# places and spans

@query(f"""WITH {DOCS} SELECT doc_id, doc_id % 26 AS "at", CASE WHEN doc_id % 26 < 4 THEN 'Doc.first' WHEN doc_id % 26 IN (8, 9) THEN 'Doc.part.a' WHEN doc_id % 26 IN (10, 11) THEN 'Doc.part.b' ELSE 'Doc.tail' END AS path FROM d
    WHERE octet_length(b) >= 24 AND (doc_id % 26 < 4 OR doc_id % 26 BETWEEN 8 AND 11 OR doc_id % 26 BETWEEN 20 AND 23)""")
def jn_field_at(spark, sf_dir):
    """Which field a place selects, in a tree with two pointers to the same bytes outside the root's span."""
    o = documents(spark, sf_dir).filter(F.octet_length("content") >= 24)
    points = o.select("object_id", (number("object_id") % 26).alias("at"))
    return spans.deepest(points, parse.parse(o, HEADED, covered=False)).select(number("object_id").alias("doc_id"), "at", "path")


@query("""SELECT s_suppkey, place::BIGINT AS "at", CASE WHEN place < 2 THEN 'S.n' WHEN place < 2 + 4 * n AND (place - 2) % 4 < 3 THEN 'S.items[' || ((place - 2) // 4) || '].a' WHEN place < 2 + 4 * n THEN 'S.items[' || ((place - 2) // 4) || '].b' ELSE 'S.tail' END AS path
    FROM (SELECT s_suppkey, s_suppkey % 6 AS n, unnest([0, 1, 2, 4, 5, 9, 17, 21, 25]) AS place FROM supplier) WHERE place < 2 + 4 * n + 1""")
def jn_field_in_array(spark, sf_dir):
    """The same in arrays of structs, several places an object."""
    n = F.col("s_suppkey") % 6
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("object_id"), F.concat(be(n, 2), F.unhex(F.repeat(F.lit("00000102"), n.cast("int"))), F.lit(b"!")).alias("content"))
    points = o.select("object_id", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 2, 4, 5, 9, 17, 21, 25)])).alias("at"))
    f = parse.fields(parse.parse(o, "// @endian be\n// @entry S\nstruct I { a bytes[3] b u8 } struct S { n u16 items I[n] tail u8 }", covered=False))
    return spans.deepest(points, f).select(number("object_id").alias("s_suppkey"), "at", "path")


UNCOVERED = f"""{SPANS}, t AS (SELECT id, a, z FROM i UNION ALL SELECT o_orderkey, 300, 300 FROM orders),
    w AS (SELECT *, coalesce(max(z) OVER (PARTITION BY id ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), u AS (SELECT id, before AS place, a - before AS len FROM w WHERE a > before)"""


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"), F.lit(300).cast("bigint").alias("total"))
    return spans.uncovered(line_spans(spark, sf_dir), totals)


@query(f"""WITH {UNCOVERED} SELECT o_orderkey, o_custkey % 300 AS "at", coalesce(min(CASE WHEN place > o_custkey % 300 THEN place END), min(place)) AS gap FROM orders LEFT JOIN u ON id = o_orderkey GROUP BY ALL""")
def jn_gap_after(spark, sf_dir):
    """The next gap after a place, or the first one."""
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"), (F.col("o_custkey") % 300).alias("at"))
    return spans.gap_after(points, order_gaps(spark, sf_dir)).select(number("object_id").alias("o_orderkey"), "at", F.col("gap_offset").alias("gap"))


@query(f"""WITH {UNCOVERED}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len DESC, place) AS rank FROM u) SELECT id AS o_orderkey, place AS "offset", len, rank::BIGINT AS rank FROM r WHERE rank <= 2""")
def srt_largest_gaps(spark, sf_dir):
    """A top-k report: the two largest gaps of each order."""
    return spans.largest_gaps(order_gaps(spark, sf_dir), 2).select(number("object_id").alias("o_orderkey"), "offset", "len", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {DOCS}, r(k, name, a, n) AS (VALUES (1, 'D', 0, 16), (2, 'D.a', 0, 4), (3, 'D.b', 4, 4), (4, 'D.c', 8, 8)) SELECT doc_id, name AS path FROM d, r WHERE octet_length(b) >= 16 AND a < doc_id % 13 + 3 AND a + n > doc_id % 13""")
def jn_touched(spark, sf_dir):
    """The fields that a span touches, containers included."""
    o = documents(spark, sf_dir).filter(F.octet_length("content") >= 16)
    runs = o.select("object_id", (number("object_id") % 13).alias("offset"), F.lit(3).cast("bigint").alias("size"))
    f = parse.fields(parse.parse(o, "struct D { a u32 b u32 c u64 }", covered=False))
    return spans.touched(f, runs).select(number("object_id").alias("doc_id"), "path")


# strings, checksums, transforms, searches

@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS m, length(c_name) AS n, length(c_mktsegment) AS k, c_custkey % 2 AS pad FROM customer)
    SELECT c_custkey, 0 AS ordinal, 0::BIGINT AS offset, n::BIGINT AS size, 'ascii' AS encoding, c_name AS text FROM c
    UNION ALL SELECT c_custkey, 1, n + 2 + pad, 2 * k, 'utf16le', m FROM c UNION ALL SELECT c_custkey, 2, n + 4 + pad + 2 * k, 2 * k, 'utf16be', m FROM c""")
def win_wide_strings(spark, sf_dir):
    """ASCII, then the same text in both orders of UTF-16 at either alignment; what the other order sees one byte on is dropped."""
    pad = F.when(F.col("c_custkey") % 2 == 1, F.lit(b"\xff")).otherwise(F.lit(b""))
    content = F.concat(utf8("c_name"), F.lit(b"\xff\xff"), pad, F.encode("c_mktsegment", "UTF-16LE"), F.lit(b"\xff\xff"), F.encode("c_mktsegment", "UTF-16BE"))
    s = analysis.strings(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), content.alias("content")), 5)
    return s.select(number("object_id").alias("c_custkey"), "ordinal", "offset", "size", "encoding", "text")


def _crc_sql() -> str:
    """One bit a round, all names at once."""
    names = list(CRC16)
    start = ", ".join(f"{CRC16[n][2]} AS {n}" for n in names)
    step = []
    for n in names:
        poly, reflected, _ = CRC16[n]
        mixed = f"(CASE WHEN k % 8 = 0 THEN xor({n}, {'v' if reflected else 'v * 256'}) ELSE {n} END)"
        step.append(f"CASE WHEN {mixed} % 2 = 1 THEN xor({mixed} // 2, {poly}) ELSE {mixed} // 2 END AS {n}" if reflected else f"CASE WHEN {mixed} >= 32768 THEN xor(({mixed} * 2) % 65536, {poly}) ELSE {mixed} * 2 END AS {n}")
    return f"""WITH RECURSIVE d AS (SELECT c_custkey, hex(encode(c_name || c_mktsegment)) AS h FROM customer), x AS (SELECT c_custkey, h, 0 AS k, {start} FROM d
        UNION ALL SELECT c_custkey, h, k + 1, {', '.join(step)} FROM (SELECT *, ('0x' || substr(h, 2 * (k // 8) + 1, 2))::INTEGER AS v FROM x WHERE k < 4 * length(h)))
        SELECT c_custkey, {', '.join(f'{n}::BIGINT AS {n}, {n}::BIGINT AS {n}_column' for n in names)} FROM x WHERE k = 4 * length(h)"""


@query(_crc_sql())
def fn_crc16(spark, sf_dir):
    """The four sums of 16 bits, by the function over bytes and by expressions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), utf8(F.concat("c_name", "c_mktsegment")).alias("content"))
    by_column = c.select("object_id", *[checksum_column(n, F.col("content")).alias(f"{n}_column") for n in CRC16])
    return checks.checksums(c, tuple(CRC16)).join(by_column, "object_id").withColumn("c_custkey", number("object_id")).drop("object_id")


CHAINS = {
    "gunzip": "body bytes[*] decode gunzip",
    "inflate": "body bytes[*] decode inflate",
    "add": "body bytes[*] decode add(7)",
    "sub": "body bytes[*] decode sub(250)",
    "rolling": "body bytes[*] decode rolling_xor(17, 5, 3)",
}


def _masked(data: bytes) -> bytes:
    k, out = 17, bytearray(data)
    stream = bytearray()
    for _ in range(min(256, len(out))):
        stream.append(k)
        k = (k * 5 + 3) % 256
    for i in range(len(out)):
        out[i] ^= stream[i % len(stream)]
    return bytes(out)


def _raw_deflate(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


PACK = {"gunzip": lambda d: gzip.compress(d, 1) + b"tail", "inflate": _raw_deflate, "add": lambda d: bytes((b - 7) % 256 for b in d), "sub": lambda d: bytes((b + 250) % 256 for b in d), "rolling": _masked}


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS chain, md5(coalesce(text, '')) AS md5 FROM documents" for n in CHAINS))
def fn_transforms(spark, sf_dir):
    """Each transform undone on whole documents; the stream of rolling_xor comes round after 256 bytes."""
    out = None
    for name, body in CHAINS.items():
        pack = F.arrow_udf(lambda data, f=PACK[name]: pa.array([f(x.as_py()) for x in data], pa.binary()), "binary")
        f = parse.fields(parse.parse(documents(spark, sf_dir).select("object_id", pack("content").alias("content")), f"struct D {{ {body} }}", paths=["D.body"], mode="FAILFAST", covered=False))
        rows = f.select(number("object_id").alias("doc_id"), F.lit(name).alias("chain"), F.md5("v_bytes").alias("md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


HITS = f"{DOCS}, f AS (SELECT doc_id, i FROM (SELECT *, unnest(range(octet_length(b))) AS i FROM d) WHERE substr(h, 2 * i + 1, 6) = '746865')"


@query(f"WITH {HITS} SELECT doc_id, max(CASE WHEN i < 300 THEN i END) AS before, min(CASE WHEN i >= 300 THEN i END) AS after FROM f GROUP BY doc_id")
def search_around(spark, sf_dir):
    """The last hit before a place and the first at or after it."""
    hits = search.find_all(documents(spark, sf_dir), B.needle("hex", "74 68\n65"))
    either = search.before(hits, 300).withColumnRenamed("offset", "before").join(search.after(hits, 300).withColumnRenamed("offset", "after"), "object_id", "full")
    return either.select(number("object_id").alias("doc_id"), "before", "after")


def _needle_sql() -> str:
    sought = {"value be": "00000011", "value le": "11000000", "negative": "FFFE", "0x": "0011", "utf16": "4F005200"}
    h = "lpad(to_hex(o_custkey), 8, '0') || upper(hex(encode(o_orderstatus))) || 'FFFE' || (SELECT string_agg(x || '00', '') FROM (SELECT unnest(regexp_extract_all(hex(encode(o_orderpriority)), '..')) AS x))"
    rows = " UNION ALL ".join(f"SELECT '{n}' AS kind, o_orderkey, i AS offset FROM e WHERE substr(h, 2 * i + 1, {len(x)}) = '{x}'" for n, x in sought.items())
    wide = "array_to_string(list_transform(regexp_extract_all(hex(encode(o_orderpriority)), '..'), lambda x: x || '00'), '')"
    return f"WITH o AS (SELECT o_orderkey, lpad(to_hex(o_custkey), 8, '0') || reverse_pairs || 'FFFE' || wide AS h FROM (SELECT *, {wide} AS wide, array_to_string(list_reverse(regexp_extract_all(lpad(to_hex(o_custkey), 8, '0'), '..')), '') AS reverse_pairs FROM orders)), e AS (SELECT *, unnest(range(length(h) // 2)) AS i FROM o) {rows}"  # noqa: E501


@query(_needle_sql())
def search_needles(spark, sf_dir):
    """Numbers in both orders, a negative one, one in hex, and a text in UTF-16."""
    content = F.concat(be(F.col("o_custkey"), 4), le(F.col("o_custkey"), 4), F.lit(b"\xff\xfe"), F.encode("o_orderpriority", "UTF-16LE"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"), content.alias("content"))
    sought = {
        "value be": B.needle("value", "17", width=4, big=True), "value le": B.needle("value", "17", width=4), "negative": B.needle("value", "-2", width=2, big=True), "0x": B.needle("value", "0x11", width=2, big=True),
        "utf16": B.needle("utf16", "OR"),
    }
    out = None
    for kind, n in sought.items():
        rows = search.find_all(o, n).select(F.lit(kind).alias("kind"), number("object_id").alias("o_orderkey"), "offset")
        out = rows if out is None else out.unionByName(rows)
    return out


# guesses and hints

STAMP = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT event_id, 'ascii' AS label, event_type AS detail FROM events WHERE event_id % 6 = 0 AND length(event_type) >= 4
    UNION ALL SELECT event_id, 'unix seconds u64 little', {STAMP} FROM events WHERE event_id % 6 = 1 UNION ALL SELECT event_id, 'unix milliseconds u64 big', {STAMP} FROM events WHERE event_id % 6 = 2
    UNION ALL SELECT event_id, 'windows filetime u64 little', {STAMP} FROM events WHERE event_id % 6 = 3
    UNION ALL SELECT event_id, 'dos date', strftime(date_trunc('second', ts) - to_seconds(second(ts) % 2), '%Y-%m-%d %H:%M:%S') FROM events WHERE event_id % 6 = 4
    UNION ALL SELECT event_id, 'uuid v4', m[1:8] || '-' || m[9:12] || '-4' || m[14:16] || '-' || m[17:20] || '-' || m[21:32] FROM (SELECT event_id, md5(event_id::VARCHAR) AS m FROM events) WHERE event_id % 6 = 5""")
def fn_guess_values(spark, sf_dir):
    """What 16 bytes may be: texts, times of five kinds, identifiers."""
    k, t = F.col("event_id"), F.col("ts").cast("timestamp")
    s = F.unix_timestamp(t)
    dos_time = F.hour(t) * 2048 + F.minute(t) * 32 + F.floor(F.second(t) / 2)
    dos_date = (F.year(t) - 1980) * 512 + F.month(t) * 32 + F.dayofmonth(t)
    m = F.md5(k.cast("string"))
    contents = [F.concat(utf8("event_type"), F.lit(b"\0")), le(s, 8), be(s * 1000 + 7, 8), le((s + 11_644_473_600) * 10_000_000, 8), F.concat(le(dos_time, 2), le(dos_date, 2)), F.unhex(F.concat(F.substring(m, 1, 12), F.lit("4"), F.substring(m, 14, 19)))]
    labels = ["ascii", "unix seconds u64 little", "unix milliseconds u64 big", "windows filetime u64 little", "dos date", "uuid v4"]
    pick = lambda of: F.element_at(F.array(*of), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(k.cast("string").alias("object_id"), pick(contents).alias("content"))
    wanted = F.element_at(F.array(*map(F.lit, labels)), (number("object_id") % 6 + 1).cast("int"))
    return analysis.guess(e).filter(F.col("label") == wanted).select(number("object_id").alias("event_id"), "label", "detail")


@query("""SELECT s_suppkey, 'offset table' AS label, (4 + s_suppkey % 5) || ' rising u32 little' AS detail, 4::BIGINT AS offset, (4 * (4 + s_suppkey % 5))::BIGINT AS size FROM supplier
    UNION ALL SELECT s_suppkey, 'string pool', '3 strings over ' || (100 * (length(s_name) + 22) // (length(s_name) + 22 + s_suppkey % 20)) || '%', 0, length(s_name) + 22 + s_suppkey % 20 FROM supplier
    UNION ALL SELECT s_suppkey, 'records', '1638 of 20 bytes', 0, 20 * 2000 FROM supplier""")
def fn_shapes(spark, sf_dir):
    """Rising offsets, pools of strings, and records that are longer than the sample they are told from."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rising = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), (4 + k % 5).cast("int")), lambda i: F.hex(le(i * 8 + (k % 7), 4))), ""))
    table_ = F.concat(F.lit(b"\xff\xff\xff\xff"), rising, F.unhex(F.repeat(F.lit("FF"), 200)))
    pool = F.concat(utf8("s_name"), F.lit(b"\0first one\0second one\0"), F.unhex(F.repeat(F.lit("01"), (k % 20).cast("int"))))
    record = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.hex(utf8("s_name")), F.lpad(F.hex(i.cast("bigint")), 4, "0"))), ""))
    out = None
    for label, content in (("offset table", table_), ("string pool", pool), ("records", record)):
        h = analysis.shape_hints(s.select(k.cast("string").alias("object_id"), content.alias("content"))).filter(F.col("label") == label)
        out = h if out is None else out.unionByName(h)
    return out.select(number("object_id").alias("s_suppkey"), "label", "detail", "offset", "size")


# plugins and catalogs

PLUGIN = '''
id = "acme"
name = "Acme"
[[formats]]
name = "Acme any"
schema = "struct A { magic char[3] }"
confidence = 60
detect = [{ hex = "41 43 4D" }]
[[formats]]
name = "Acme E"
schema = "struct E { magic char[4] zero at 6 u8 }"
confidence = 90
detect = [{ offset = 0, hex = "41434D45" }, { offset = 6, hex = "00" }]
[[formats]]
name = "No rule"
schema = "struct N { a u8 }"
detect = [{ hex = "" }, { hex = "41" }]
[[formats]]
name = "PNG by Acme"
schema = "struct P { a u8 }"
confidence = 100
detect = [{ hex = "89504E47" }]
[[formats]]
name = "Default"
schema = "struct D { a u8 }"
detect = [{ offset = 2, hex = "4D" }]
'''


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, rank, format, confidence FROM nation JOIN (VALUES
    (0, 1, 'Acme E', 90), (0, 2, 'Default', 75), (0, 3, 'Acme any', 60), (1, 1, 'Default', 75), (1, 2, 'Acme any', 60), (2, 1, 'PNG', 100), (2, 2, 'PNG by Acme', 100)) v(k, rank, format, confidence) ON n_nationkey % 4 = k""")
def fn_detect_plugins(spark, sf_dir):
    """Built-in signatures and a plugin's rules together: all parts must match, an empty part matches nothing, ties go to the more specific."""
    plugin = catalog.read_plugin(PLUGIN)
    heads = F.array(F.lit(b"ACMEab\0"), F.lit(b"ACMEab\x01"), F.lit(b"\x89PNG\r\n\x1a\n"), F.lit(b"other"))
    o = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), F.concat(F.element_at(heads, F.col("n_nationkey") % 4 + 1), utf8("n_name")).alias("content"))
    found = detect.best_first(detect.detect(o, detect.registry() + catalog.plugin_signatures([plugin])))
    return found.select(number("object_id").alias("n_nationkey"), "rank", "format", "confidence")


GOOD = 'id = "{id}"\nname = "{id}"\n[[formats]]\nname = "F {id}"\nschema = "struct A {{ a u8 }}"\n'


@query("""SELECT * FROM (VALUES ('user', 'a-layout', 'a Layout', 1), ('user', 'b-2', 'B 2', 2), ('plugin', 'acme/acme-any', 'Acme any', 3), ('plugin', 'acme/acme-e', 'Acme E', 4), ('plugin', 'acme/no-rule', 'No rule', 5), ('plugin', 'acme/png-by-acme', 'PNG by Acme', 6),
    ('plugin', 'acme/default', 'Default', 7), ('plugin', 'my-pack/my-pack', 'My Pack!', 8), ('state', 'broken', 'false', 9), ('state', 'off', 'false', 10), ('state', 'my-pack', 'true', 11), ('refused', '../x', 'path', 12), ('refused', 'no-schema', 'manifest', 13),
    ('registry', 'sub/one.toml', 'one 1', 14), ('registry', 'two.toml', 'two 1', 15)) v(source, id, name, place)""")
def cat_listing(spark, sf_dir):
    """Layouts, plugins and packs: installed, disabled, exported and read back, broken and refused; a catalog is the driver's alone."""
    with tempfile.TemporaryDirectory() as folder:  # read and deleted here, on the driver
        library, plugins = catalog.Library(f"{folder}/layouts"), catalog.PluginFolder(f"{folder}/plugins")
        for name in ("B 2", "a Layout", "gone"):
            library.add(name, "struct A { a u8 }")
        library.remove("gone")
        plugins.install(PLUGIN.replace('{ hex = "" }', '{ hex = "42" }'))
        for identity in ("off", "removed"):
            plugins.install(GOOD.format(id=identity))
        plugins.enable("off", False)
        plugins.remove("removed")
        plugins.install(catalog.export_pack("My Pack!", "// @entry B\n" + library.load("b-2"), detect=((0, "4142"),), confidence=80))
        (plugins.folder / "broken.toml").write_text("id = ")
        rows = [r for r in catalog.listing(library, plugins) if r[0] != "built-in"]
        rows += [("state", p.id, str(p.enabled and not p.error).lower()) for i in ("broken", "off", "my-pack") for p in plugins.list() if p.id == i]
        for what, identity, run in (("path", "../x", lambda: library.load("../x")), ("manifest", "no-schema", lambda: plugins.install('id = "n"\nname = "n"\n[[formats]]\nname = "f"\nschema = " "\n'))):
            try:
                run()
            except catalog.CatalogError:
                rows.append(("refused", identity, what))
        packs = catalog.Registry(f"{folder}/packs")
        for path, identity in (("two.toml", "two"), ("sub/one.toml", "one"), ("bad name.toml", "bad"), ("broken.toml", None)):
            (packs.folder / path).parent.mkdir(parents=True, exist_ok=True)
            (packs.folder / path).write_text(GOOD.format(id=identity) if identity else "id =")
        rows += [("registry", path, f"{identity} {n}") for path, identity, _, n in packs.list() if catalog.read_plugin(packs.fetch(path)).id == identity]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "source string, id string, name string, place int")


BROKEN = (
    ("struct S {\n  a u8\n  b $\n}", "unexpected_char", 3, 5), ("struct S { a u8[99999999999999999999999] }", "int_too_large", 1, 17), ('struct S { a match b { "x => u8 } }', "unterminated_string", 1, 24), ("struct S ( )", "unexpected_token", 1, 10),
    ("struct S { a u8", "unexpected_eof", None, None), ("struct S { a string }", "length_required", 1, 14), ("struct S { }\nstruct S { }", "duplicate_type", 2, 1), ("enum E : f32 { a = 1 }", "non_integer_repr", 1, 10), ("bitfield B : u8 { a 8 }", "bit_out_of_range", 1, 21),
    ("bitfield B : u8 { a 5..3 }", "bad_bit_range", 1, 24), ("struct S { a bytes[2] decode rot13 }", "unknown_transform", 1, 30), ("struct S { a bytes[2] decode add }", "bad_transform_args", 1, 30), ("struct S { a u8 check md5 over(a) }", "unknown_checksum", 1, 23),
    ("struct S { a u8 check crc32 (a) }", "expected_over", 1, 29), ("struct S { a repeat u8 while 300 }", "bad_byte_pattern", 1, 30), ("struct S { a u8 } enum E : u8 { x = 1 } bitfield B : u8 { y 0 }", None, None, None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {k is None}, {'NULL' if k is None else repr(k)}, {line or 'NULL'}, {column or 'NULL'})" for i, (_, k, line, column) in enumerate(BROKEN) if k != "unexpected_eof") + ") v(id, ok, kind, line, col)")
def dsl_errors(spark, sf_dir):
    """Where broken texts are broken, and how."""
    rows = []
    for i, (text, _, _, _) in enumerate(BROKEN):
        r = validate(text).iloc[0]
        if r["kind"] != "unexpected_eof":
            rows.append((i, bool(r["ok"]), r["kind"], None if r["line"] is None else int(r["line"]), None if r["column"] is None else int(r["column"])))
    return spark.createDataFrame(rows, "id int, ok boolean, kind string, line int, col int")


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, n_regionkey::BIGINT AS region2, (n_nationkey % 2)::BIGINT AS other FROM nation""")
def dsl_inserted(spark, sf_dir):
    """A layout that was extended by fields, with a name made unique, and then used."""
    text = "// @entry N\nstruct N {\n    size u8 // its length\n    region u8\n}\n"
    text = insert_fields(text, "N", [("region", "u8"), ("name", "string[size]")])
    text = insert_fields(text, "Other", [("other", "u8")])
    text = insert_fields(text, "N", [("more", "Other")])
    o = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), F.concat(be(F.octet_length("n_name"), 1), F.lit(b"\xff"), be(F.col("n_regionkey"), 1), utf8("n_name"), be(F.col("n_nationkey") % 2, 1)).alias("content"))
    at = lambda p: F.get(F.filter("fields", lambda f: f["path"] == f"N.{p}"), F.lit(0))
    return parse.parse(o, text).select(number("object_id").alias("n_nationkey"), at("name")["v_str"].alias("name"), at("region2")["v_u"].cast("bigint").alias("region2"), at("more.other")["v_u"].cast("bigint").alias("other"))


# edits

FIELDS = """
// @endian be
// @entry N
struct N { size u8 name string[size] pop u32 temp i16le kind Kind ratio f32 on bool mark char raw bytes[4] }
enum Kind : u16 { a = 1 b = 2 }
"""
CHANGES = {"N.name": "abc ", "N.pop": " 0x7f ", "N.temp": "-2", "N.kind": "513", "N.ratio": "1.5", "N.on": "true", "N.mark": "Z", "N.raw": "0x DE AD"}


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, lpad(to_hex(length(n_name)), 2, '0') || rpad('616263', 2 * length(n_name)::INTEGER, '0') || '0000007F' || 'FEFF' || '0201' || '3FC00000' || '01' || '5A' || 'DEAD0000' AS hex FROM nation""")
def ed_field_values(spark, sf_dir):
    """Values typed for fields of every kind, encoded for their width and order, and put over the bytes."""
    o = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), F.concat(be(F.octet_length("n_name"), 1), utf8("n_name"), F.unhex(F.repeat(F.lit("11"), 18))).alias("content"))
    f = parse.fields(parse.parse(o, FIELDS, covered=False))
    changes = f.select("object_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(list(CHANGES.items()), "path string, text string")))
    log = edit.field_edits(f, changes, "be").select("object_id", F.col("offset").alias("seq"), F.lit("set").alias("op"), "offset", "bytes")
    return edit.replay(o, log).select(number("object_id").alias("n_nationkey"), F.hex("content").alias("hex"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, hex(encode(n_name)) AS hex, 0::BIGINT AS dirty, 0::BIGINT AS undone FROM nation")
def ed_clear(spark, sf_dir):
    """Cleared edits leave nothing to undo or to redo."""
    o = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), utf8("n_name").alias("content"))
    steps = [(1, "set", 0, b"X"), (2, "set", 1, b"Y"), (3, "undo", 0, None), (4, "clear", 0, None), (5, "redo", 0, None), (6, "undo", 0, None)]
    ops = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(op).alias("op"), F.lit(at).cast("bigint").alias("offset"), F.lit(b).cast("binary").alias("bytes")) for s, op, at, b in steps])
    r = edit.replay(o, o.select("object_id", F.explode(ops).alias("e")).select("object_id", "e.*"))
    return r.select(number("object_id").alias("n_nationkey"), F.hex("content").alias("hex"), F.size("dirty").cast("bigint").alias("dirty"), F.col("n_undone").cast("bigint").alias("undone"))
