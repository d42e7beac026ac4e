"""What DuckDB should find for each registered query; columns carry the same names."""

from __future__ import annotations

from ..operators.detect import registry
from .queries import LEAVES, RECORD_SQL

#: Documents as hex digits, and a row per byte.
DOCS = "d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents)"
BYTES = DOCS + ", x AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS v, octet_length(b) AS n FROM (SELECT *, unnest(range(octet_length(b))) AS i FROM d))"
PAIRS = """p AS (SELECT a.doc_id, hex(encode(a.text)) AS l, hex(encode(b.text)) AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    c AS (SELECT doc_id, i FROM (SELECT *, unnest(range(least(length(l), length(r)) // 2)) AS i FROM p) WHERE substr(l, 2 * i + 1, 2) <> substr(r, 2 * i + 1, 2)),
    g AS (SELECT doc_id, min(i) AS offset_, count(*) AS size FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c) GROUP BY doc_id, k)"""
SPANS = """s AS (SELECT l_orderkey AS id, l_partkey % 200 AS a, l_partkey % 200 + l_quantity::BIGINT AS z FROM lineitem WHERE l_quantity::BIGINT > 0),
    m AS (SELECT *, max(z) OVER (PARTITION BY id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    i AS (SELECT id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM m) GROUP BY id, k)"""


def _u(start: int, size: int, big: bool) -> str:
    """SQL for an unsigned number in the hex digits h."""
    parts = [f"substr(h, {2 * (start + i) + 1}, 2)" for i in (range(size) if big else reversed(range(size)))]
    return f"CASE WHEN length(h) >= {2 * (start + size)} THEN ('0x' || {' || '.join(parts)})::UBIGINT END"


def _i(size: int, big: bool) -> str:
    """SQL for the signed number at the beginning of h."""
    u = f"({_u(0, size, big)})::BIGINT"
    return f"(CASE WHEN {u} >= {1 << (8 * size - 1)} THEN {u} - {1 << (8 * size)} ELSE {u} END)"


def _f(size: int, big: bool) -> str:
    """SQL for the float at the beginning of h, if it is a normal one."""
    bits, bias = (23, 127) if size == 4 else (52, 1023)
    u, power = f"({_u(0, size, big)})::HUGEINT", f"(({_u(0, size, big)})::HUGEINT // {1 << bits} % {2 * bias + 2})"
    return f"(CASE WHEN {u} >= {1 << (8 * size - 1)} THEN -1.0 ELSE 1.0 END::DOUBLE * (1.0::DOUBLE + ({u} % {1 << bits})::DOUBLE / {float(1 << bits)!r}::DOUBLE) * pow(2.0::DOUBLE, ({power} - {bias})::DOUBLE))"


#: Readings offered for a printable span of each size.
_CANDIDATES = {
    1: ["u8", "i8", "bool", "char", "bytes[1]"], 2: ["char[2]", "u16", "i16", "bytes[2]"], 3: ["char[3]", "bytes[3]"], 4: ["char[4]", "u32", "i32", "f32", "u16[2]", "bytes[4]"], 5: ["char[5]", "bytes[5]"],
    6: ["char[6]", "u16[3]", "bytes[6]"], 7: ["char[7]", "bytes[7]"], 8: ["char[8]", "u64", "i64", "f64", "u16[4]", "u32[2]", "bytes[8]"],
}


def _best_formats() -> str:
    """(remainder, format, confidence) of each magic: what else matches its bytes and comes before it counts."""
    rows = []
    known = registry()
    for s in known:
        data = bytearray()
        for offset, h in s["parts"]:
            data = data.ljust(offset, b"\0") + bytes.fromhex(h)
        fits = [k for k in known if all(bytes(data[o : o + len(h) // 2]) == bytes.fromhex(h) for o, h in k["parts"])]
        best = min(fits, key=lambda k: (-k["confidence"], -k["magic_bytes"], k["ordinal"]))
        rows.append(f"({s['ordinal']}, '{best['format']}', {best['confidence']})")
    return ", ".join(rows)


_BUILT_IN = {"PNG": "png", "GZIP": "gzip", "ZIP": "zip", "ELF": "elf", "PE": "pe", "Mach-O": "mach-o", "PCAP": "pcap", "SQLite": "sqlite", "WASM": "wasm", "GIF": "gif"}

SQL = {
    "src_endian_reads": f"""WITH {DOCS} SELECT doc_id, ({_u(0, 2, True)})::BIGINT AS u16_be, ({_u(0, 2, False)})::BIGINT AS u16_le, ({_u(1, 4, True)})::BIGINT AS u32_be, ({_u(1, 4, False)})::BIGINT AS u32_le,
        (CASE WHEN ({_u(3, 1, True)}) > 127 THEN ({_u(3, 1, True)})::BIGINT - 256 ELSE ({_u(3, 1, True)})::BIGINT END) AS i8,
        (CASE WHEN ({_u(0, 4, False)}) > 2147483647 THEN ({_u(0, 4, False)})::BIGINT - 4294967296 ELSE ({_u(0, 4, False)})::BIGINT END) AS i32_le, ({_u(0, 8, True)})::VARCHAR AS u64_be FROM d""",
    "src_interpretations": f"""WITH {DOCS}, e AS (SELECT doc_id, substr(h, 2 * (doc_id % 11) + 1) AS h FROM d) SELECT doc_id, ({_u(0, 1, True)})::BIGINT AS u8, {_i(1, True)} AS i8, ({_u(0, 2, False)})::BIGINT AS u16_le, ({_u(0, 2, True)})::BIGINT AS u16_be,
        ({_u(0, 4, False)})::BIGINT AS u32_le, ({_u(0, 4, True)})::BIGINT AS u32_be, ({_u(0, 8, False)})::VARCHAR AS u64_le, ({_u(0, 8, True)})::VARCHAR AS u64_be, {_i(4, False)} AS i32_le, {_i(4, True)} AS i32_be,
        {_f(4, False)} AS f32_le, {_f(4, True)} AS f32_be, {_f(8, False)} AS f64_le, {_f(8, True)} AS f64_be FROM e""",
    "src_pages": f"""WITH {DOCS}, p AS (SELECT doc_id, h, unnest(range((octet_length(b) + 999) // 1000)) AS page FROM d)
        SELECT doc_id, page, page * 1000 AS offset, (length(substr(h, page * 2000 + 1, 2000)) // 2)::BIGINT AS size, md5(unhex(substr(h, page * 2000 + 1, 2000))) AS md5 FROM p""",
    "src_region": f"WITH {DOCS} SELECT doc_id, substr(h, 21, 200) AS hex FROM d",
    "src_strict_text": f"""WITH {DOCS} SELECT doc_id, NOT regexp_matches(h, '^(..)*[89A-F]') AS is_ascii,
        regexp_full_match(regexp_replace(h, '(..)(..)', '\\2\\1', 'g'), '(([0-9A-CEF].|D[0-7])..|D[89AB]..D[C-F]..)*') AS is_utf16le FROM d""",
    "src_hex_and_bits": "SELECT n_nationkey::BIGINT AS n_nationkey, '00 ' || lpad(upper(to_hex(n_nationkey)), 2, '0') AS hex, '00000000 ' || lpad(to_binary(n_nationkey), 8, '0') AS bits FROM nation",
    "prj_record": RECORD_SQL,
    "prj_record_interpreted": RECORD_SQL,
    "prj_varint_orders": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS item, l_partkey AS part,
        CASE WHEN l_returnflag = 'R' THEN l_suppkey % 65536 END AS extra FROM lineitem""",
    "prj_tagged_union": """SELECT event_id, CASE WHEN event_type[:5] = 'click' THEN 'u16' ELSE 'string[size]' END AS kind, CASE WHEN event_type[:5] = 'click' THEN user_id % 65536 END AS x,
        CASE WHEN event_type[:5] <> 'click' THEN event_type END AS body FROM events""",
    "prj_faults": f"""WITH {DOCS}, n AS (SELECT doc_id, least(octet_length(b), 22) AS n FROM d)
        SELECT doc_id, CASE WHEN n < 8 THEN 'D.a' WHEN n < 16 THEN 'D.b' WHEN n < 20 THEN 'D.c' ELSE 'D.d' END AS path, 'out_of_bounds' AS kind, (CASE WHEN n < 8 THEN 0 WHEN n < 16 THEN 8 WHEN n < 20 THEN 16 ELSE 20 END)::BIGINT AS offset FROM n""",
    "agg_coverage": f"WITH {DOCS} SELECT doc_id, octet_length(b)::BIGINT AS total, 12::BIGINT AS covered, round(12.0::DOUBLE / octet_length(b), 9) AS fraction, (2 + (octet_length(b) > 24)::INTEGER)::BIGINT AS n_gaps FROM d WHERE octet_length(b) >= 24",
    "agg_failed_checks": "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag, count(*) AS n, count_if(l_orderkey % 7 = 0)::BIGINT AS failed FROM lineitem GROUP BY l_returnflag",
    "fn_checksums": f"""WITH {BYTES} SELECT d.doc_id, coalesce(sum(v), 0)::BIGINT % 256 AS sum8, coalesce(sum(v), 0)::BIGINT % 65536 AS sum16, coalesce(sum(v), 0)::BIGINT AS sum32, coalesce(bit_xor(v), 0)::BIGINT AS xor8,
        ((max(octet_length(d.b)) + coalesce(sum((n - i) * v), 0)::BIGINT) % 65521) * 65536 + (1 + coalesce(sum(v), 0)::BIGINT) % 65521 AS adler32 FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id""",
    "fn_checksum_columns": """WITH d AS (SELECT c_custkey, hex(encode(concat_ws('|', c_name, c_mktsegment))) AS h FROM customer),
        x AS (SELECT c_custkey, i, length(h) // 2 AS n, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS v FROM (SELECT *, unnest(range(length(h) // 2)) AS i FROM d))
        SELECT c_custkey, sum(v)::BIGINT % 256 AS sum8, sum(v)::BIGINT % 65536 AS sum16, bit_xor(v)::BIGINT AS xor8, ((max(n) + sum((n - i) * v)::BIGINT) % 65521) * 65536 + (1 + sum(v)::BIGINT) % 65521 AS adler32 FROM x GROUP BY c_custkey""",
    "agg_entropy": f"""WITH {BYTES}, c AS (SELECT doc_id, least(i // (n // least(8, n)), least(8, n) - 1) AS bucket, v, count(*) AS k FROM x GROUP BY ALL),
        p AS (SELECT *, k / sum(k) OVER (PARTITION BY doc_id, bucket) AS q FROM c) SELECT doc_id, bucket::BIGINT AS bucket, round(abs(-sum(q * log2(q)) / 8)::FLOAT::DOUBLE, 4) AS entropy FROM p GROUP BY doc_id, bucket""",
    "agg_entropy_summary": f"""WITH {BYTES}, c AS (SELECT doc_id, least(i // (n // least(64, n)), least(64, n) - 1) AS bucket, v, count(*) AS k FROM x GROUP BY ALL),
        p AS (SELECT *, k / sum(k) OVER (PARTITION BY doc_id, bucket) AS q FROM c), e AS (SELECT doc_id, bucket::BIGINT AS bucket, abs(-sum(q * log2(q)) / 8)::FLOAT AS v FROM p GROUP BY doc_id, bucket)
        SELECT doc_id, round(avg(v::DOUBLE), 4) AS mean, round(max(v)::DOUBLE, 4) AS peak, max(v) > 0.95 AS packed, arg_max(bucket, {{'v': v, 'b': bucket}}) AS peak_bucket FROM e GROUP BY doc_id""",
    "win_strings": """WITH s AS (SELECT doc_id, regexp_extract_all(text, '[ -~]{6,}') AS l FROM documents)
        SELECT doc_id, i AS ordinal, length(l[i + 1])::BIGINT AS size, 'ascii' AS encoding, l[i + 1] AS text FROM (SELECT *, unnest(range(len(l))) AS i FROM s)""",
    "srt_limited_strings": """WITH s AS (SELECT page_id, regexp_extract_all(html, '[ -~]{6,}') AS l FROM pages)
        SELECT page_id, l[i + 1] AS text, len(l)::BIGINT AS total_rows, len(l) > 3 AS truncated FROM (SELECT *, unnest(range(least(3, len(l)))) AS i FROM s)""",
    "search_all": f"WITH {DOCS} SELECT doc_id, i AS offset FROM (SELECT *, unnest(range(octet_length(b))) AS i FROM d) WHERE substr(h, 2 * i + 1, 6) = '746865'",
    "search_first": f"""WITH {DOCS}, f AS (SELECT doc_id, i FROM (SELECT *, unnest(range(octet_length(b))) AS i FROM d) WHERE substr(h, 2 * i + 1, 6) = '746865')
        SELECT d.doc_id, min(i) AS first, min(CASE WHEN i >= 100 THEN i END) AS after_100 FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "search_benchmark": "SELECT doc_id, item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "diff_summary": f"WITH {PAIRS} SELECT p.doc_id, (length(max(l)) // 2)::BIGINT AS left_size, (length(max(r)) // 2)::BIGINT AS right_size, coalesce(sum(size), 0)::BIGINT AS changed, count(size) AS runs FROM p LEFT JOIN g USING (doc_id) GROUP BY p.doc_id",
    "diff_runs": f"WITH {PAIRS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY offset_) - 1 AS run, offset_ AS offset, size FROM g",
    "jn_next_change": f"""WITH {PAIRS}, t AS (SELECT doc_id, (length(l) // 4)::BIGINT AS point FROM p)
        SELECT t.doc_id, point AS "at", min(CASE WHEN offset_ > point THEN offset_ END) AS next, max(CASE WHEN offset_ < point THEN offset_ END) AS previous FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id, point""",
    "jn_tree_diff": """SELECT path, CASE WHEN l_orderkey % 5 = 0 AND path <> 'Record.partkey' THEN 'changed' ELSE 'same' END AS status, count(*) AS n
        FROM lineitem, (VALUES ('Record'), ('Record.quantity'), ('Record.quantity.cents'), ('Record.partkey'), ('Record.crc')) f(path) GROUP BY ALL""",
    "jn_deepest_field": "SELECT 'Record.' || name AS path, l_partkey % 35 AS \"at\", count(*) AS n FROM lineitem JOIN (VALUES " + ", ".join(f"('{n}', {o}, {s})" for n, o, s in LEAVES) + ") f(name, o, s) ON l_partkey % 35 >= o AND l_partkey % 35 < o + s GROUP BY ALL",
    "jn_overlaps": """SELECT o_orderkey, count(*) AS n, sum(l_partkey % 200)::BIGINT AS offsets FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_partkey % 200 < o_custkey % 150 + 60
        AND o_custkey % 150 < l_partkey % 200 + l_quantity::BIGINT GROUP BY o_orderkey""",
    "win_islands": f"WITH {SPANS} SELECT id AS l_orderkey, a AS offset, z - a AS size FROM i",
    "win_uncovered": f"""WITH {SPANS}, t AS (SELECT id, a, z FROM i UNION ALL SELECT o_orderkey, 300, 300 FROM orders),
        w AS (SELECT *, coalesce(max(z) OVER (PARTITION BY id ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT id AS o_orderkey, before AS offset, a - before AS len FROM w WHERE a > before""",
    "fn_detect": f"SELECT doc_id, format, confidence::BIGINT AS confidence FROM documents JOIN (VALUES {_best_formats()}) f(k, format, confidence) ON doc_id % {len(registry())} = k",
    "jn_schema_of_format": f"""SELECT format, schema_id, count(*) AS n FROM documents JOIN (VALUES {_best_formats()}) f(k, format, confidence) ON doc_id % {len(registry())} = k
        JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _BUILT_IN.items())}) s(format, schema_id) USING (format) GROUP BY ALL""",
    "fn_guess": """WITH e AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS v FROM events), b AS (SELECT *, (v % 256) * 16777216 + (v // 256 % 256) * 65536 + (v // 65536 % 256) * 256 + v // 16777216 AS r, v % 65536 AS t, v // 65536 AS d FROM e)
        SELECT event_id, 'unix seconds u32 little' AS label, strftime(make_timestamp(v * 1000000), '%Y-%m-%d %H:%M:%S') AS detail FROM b
        UNION ALL SELECT event_id, 'unix seconds u32 big', strftime(make_timestamp(r * 1000000), '%Y-%m-%d %H:%M:%S') FROM b WHERE r BETWEEN 1000000000 AND 2147483647
        UNION ALL SELECT event_id, 'dos date', format('{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}', 1980 + d // 512, d // 32 % 16, d % 32, t // 2048, t // 32 % 64, t % 32 * 2) FROM b
            WHERE 1980 + d // 512 BETWEEN 1990 AND 2040 AND d // 32 % 16 BETWEEN 1 AND 12 AND d % 32 >= 1 AND t // 2048 < 24 AND t // 32 % 64 < 60 AND t % 32 < 30""",
    "fn_hints": """SELECT 'f' || s_suppkey AS object_id, 'fill' AS label, (s_suppkey % 50 + 8)::BIGINT AS size FROM supplier
        UNION ALL SELECT 's' || s_suppkey, 'size prefix', 4 FROM supplier""",
    "fn_decode_base64": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "fn_decode_zlib": "SELECT doc_id, md5(text) AS md5, 2::BIGINT AS space_id FROM documents",
    "ed_replay": f"WITH {DOCS} SELECT doc_id, md5(unhex(substr(h, 1, 4) || '58595A' || substr(h, 11, 6) || '21' || substr(h, 19))) AS md5, 4::BIGINT AS dirty, 2::BIGINT AS n_done, 1::BIGINT AS refused FROM d WHERE octet_length(b) >= 10",
    "ed_overlay": f"WITH {DOCS} SELECT doc_id, md5(unhex(substr(h, 1, 4) || '58595A' || substr(h, 11, 6) || '21' || substr(h, 19))) AS md5 FROM d WHERE octet_length(b) >= 10",
    "ed_last_edit": "SELECT place::BIGINT AS \"at\", byte::BIGINT AS byte, count(*) AS n FROM documents, (VALUES (2, 88), (3, 89), (4, 81), (5, 81)) v(place, byte) WHERE octet_length(encode(text)) >= 10 GROUP BY ALL",
    "ed_fix_checksums": "SELECT (l_orderkey % 7 = 0)::BIGINT AS fixed, 0::BIGINT AS remaining, count(*) AS n FROM lineitem GROUP BY ALL",
    "snk_tree_text": """SELECT n_nationkey::BIGINT AS n_nationkey, '  name: string[size] = "' || n_name || '"  [@2 +' || octet_length(encode(n_name)) || ']' AS name_line, n_name AS name FROM nation""",
    "dsl_candidates": "SELECT size, type, count(*) AS n FROM (SELECT s_suppkey % 9 AS size, unnest(CASE s_suppkey % 9 " + " ".join(f"WHEN {n} THEN {names}" for n, names in _CANDIDATES.items()) + " END) AS type FROM supplier) GROUP BY ALL",
    "dsl_suggested_names": """WITH p AS (SELECT p_partkey, p_name || '  ' || p_type AS x, p_partkey % 9 AS a, p_partkey % 13 AS n FROM part), t AS (SELECT *, trim(substr(x, a + 1, n)) AS t FROM p)
        SELECT p_partkey, CASE WHEN n > 0 AND a + n <= length(x) AND regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') THEN lower(t) ELSE 'field_' || lower(to_hex(a)) END AS name FROM t""",
}
