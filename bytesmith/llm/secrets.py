"""Secret scans: fixed base patterns, and windows of high entropy per character class. DataFrame functions only.

Base kinds (leftmost, non-overlapping per kind): assign, access, hex. The method adds spans of kind entropy_hex,
entropy_word, entropy_hex_upper (hex with capitals, or mixed), entropy_upper (base32 and other capitals with digits), entropy_lower and
entropy_mixed (letters of both cases with digits, without seven small letters in a row, as names of programs have): in candidate
strings (maximal runs of a class's characters of `window` or more) a window slides by one character; its counts, and with them the sum of c * log2(c), change by the character that enters and the one that
leaves, and the Shannon entropy is log2(window) - sum / window. A candidate one of whose windows reaches its class's
bound is a span, unless it is allowed: windows that touch an allow-listed pattern don't count, and candidates that are allow-listed as a whole, that
have no digit or no letter, or (but for entropy_hex) that lie in a base span are none. Base spans always stay. Time is linear in a text's length,
in the length of a run and (by blocks of sums) in the number of matches.

A run may be a span of several kinds. Of random keys of 20 characters 99 % are found in hex with capitals, 98 % in base32, 99 % in small
letters with digits and 95 % in letters of both cases with digits (4,000 keys each); of 32 characters 99.7 % or more.

Offsets are code points, end exclusive. A null or empty text has no spans. Repeated rows and ties are rows of their own; an
empty table gives no rows; other columns pass through."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in order, with their patterns and least lengths.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Here the least length is in the pattern: a run too short hides no other match, and most runs of a to f are short words.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


@dataclass(frozen=True)
class Kind:
    """group and least: the group whose length must reach `least`."""

    name: str
    pattern: str
    group: int
    least: int


BASE = (Kind("assign", ASSIGN, 2, 6), Kind("access", ACCESS, 0, 20), Kind("hex", HEX, 0, 24))


@dataclass(frozen=True)
class CharClass:
    """pattern: candidate strings; alphabet: its characters; bound: least entropy of a window, in bits."""

    name: str
    pattern: str
    alphabet: str
    bound: float


HEX_DIGITS = string.digits + "abcdef"
WORD = string.ascii_letters + string.digits + "+/_=-"
WINDOW = 20
CLASSES = (
    CharClass("entropy_hex", "(?<![0-9a-f])[0-9a-f]{20,}+", HEX_DIGITS, 3.0),
    CharClass("entropy_word", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", WORD, 3.9),
    CharClass("entropy_hex_upper", "(?<![0-9A-Fa-f])(?=[0-9a-f]*[A-F])[0-9A-Fa-f]{20,}+", HEX_DIGITS + "ABCDEF", 2.9),
    CharClass("entropy_upper", "(?<![A-Z0-9])[A-Z0-9]{20,}+", string.digits + string.ascii_uppercase, 3.3),
    CharClass("entropy_lower", "(?<![a-z0-9])[a-z0-9]{20,}+", string.digits + string.ascii_lowercase, 3.4),
    CharClass("entropy_mixed", "(?<![A-Za-z0-9])(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])(?![A-Za-z0-9]*[a-z]{7})[A-Za-z0-9]{20,}+", string.digits + string.ascii_letters, 3.7),
)
#: What has the shape of a secret and is none: identifiers as a whole; counting strings and words of
#: documentation where they stand in a run, whose windows then lie before or after them.
ALLOW_WHOLE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOW_WITHIN = "(?:0123456789abcdef|123456789|abcdefghij|ABCDEFGHIJ|(?i:example|placeholder|changeme|xxxxxx))"


#: Matches of a block of `_sums`.
BLOCK = 256


def _bound(value: str, name: str, body: str) -> str:
    """SQL for `body` where `name` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums(numbers: str) -> str:
    """SQL for the sum of what stands before each element of an array, in blocks, so that time is all but linear in its length."""
    inner = "aggregate(b, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))))"
    blocks = f"transform(sequence(0, (size(ns) - 1) div {BLOCK}), k -> {_bound(f'slice(ns, k * {BLOCK} + 1, {BLOCK})', 'b', inner)})"
    return _bound(numbers, "ns", f"aggregate({blocks}, named_struct('at', 0, 'out', CAST(array() AS array<array<int>>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(transform(x.out, y -> y + a.at)))), a -> flatten(a.out))")


def spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL for the spans of the matches of a pattern, by position; `text` is an expression that isn't null.

    The pieces between matches and the matches add up to the text, so positions are running sums. Texts without a match cost one search."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    sizes = f"transform(regexp_extract_all({text}, '{quoted}', {group}), x -> length(x))" if group else "transform(f, x -> length(x))"
    each = f"""transform(f, (m, i) -> named_struct('start', at[i] + length(p[i]), 'kind', {kind}, 'stop', at[i] + length(p[i]) + length(m), 'text', m, 'size', s[i]))"""
    at = _sums("transform(p, (x, i) -> length(x) + IF(i < size(f), length(f[i]), 0))")
    whole = _bound(found, "f", _bound(f"split({text}, '{quoted}', -1)", "p", _bound(sizes, "s", _bound(at, "at", each))))
    return f"CAST(IF(regexp_like({text}, '{quoted}'), filter({whole}, x -> x.size >= {least}), array()) AS {SPANS})"


SPANS = "array<struct<start:int,kind:int,stop:int,text:string,size:int>>"
#: Entropies are compared in units of 2 ** -SCALE bits a window, as whole numbers, so that no error adds up along a run.
SCALE = 40


def _units(count: int) -> int:
    return round(count * math.log2(count) * 2**SCALE) if count else 0


def exceeds(word: str, alphabet: str, bound: float, window: int = WINDOW) -> str:
    """SQL for whether a window of the string `word` has an entropy of `bound` bits; never, if it is shorter.

    The state is the counts by character, several in a number, the sum of c * log2(c) over them, and the least such sum of a full window.
    Each step takes the character out that leaves and puts the one in that enters; time is linear in the word's length."""
    bits = (window + 1).bit_length()
    per = 63 // bits
    numbers, mask = -(-len(alphabet) // per), (1 << bits) - 1
    gains = "array(" + ", ".join(f"{_units(c + 1) - _units(c)}L" for c in range(window)) + ")"
    slot = lambda c: f"shiftleft(1L, {bits} * ({c} % {per}))"
    count = lambda c: f"int(shiftright(a.n[{c} div {per}], {bits} * ({c} % {per})) & {mask}L)"
    leaves = f"IF(a.i < {window}, -1, codes[a.i - {window}])"
    step = f"""named_struct('i', a.i + 1,
        'n', transform(a.n, (v, j) -> v + IF(j = e div {per}, {slot('e')}, 0L) - IF(l >= 0 AND j = l div {per}, {slot('l')}, 0L)),
        'sum', a.sum + {gains}[{count('e')} - IF(e = l, 1, 0)] - IF(l < 0, 0L, {gains}[greatest(0, {count('greatest(l, 0)')} - 1)]),
        'least', IF(a.i < {window}, {FULL}L, least(a.least, a.sum)))"""
    most = math.floor((math.log2(window) - bound) * window * 2**SCALE)
    slide = f"aggregate(codes, named_struct('i', 0, 'n', array_repeat(0L, {numbers}), 'sum', 0L, 'least', {FULL}L), (a, e) -> {_bound(leaves, 'l', step)}, a -> least(a.least, a.sum) <= {most}L)"
    codes = f"transform(filter(split({word}, ''), c -> c != ''), c -> locate(c, '{alphabet}') - 1)"
    return f"(length({word}) >= {window} AND {_bound(codes, 'codes', slide)})"


#: More than any sum.
FULL = 1 << 62


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `base_spans` and `entropy_spans`, arrays of (start, kind, stop, text, size) by start, then kind.

    One projection: each row is scanned where it lies, and nothing is shuffled. Columns of those two names are replaced; all
    others pass through, whatever their names."""
    text = "coalesce(row.text, '')"
    base = "array_sort(concat(" + ", ".join(spans(text, kind.pattern, k, kind.group, kind.least) for k, kind in enumerate(BASE)) + "))"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("base", F.expr(base))
    names = []
    for k, c in enumerate(CLASSES, len(BASE)):
        plain = "NOT (regexp_like(x.text, '[0-9]') AND regexp_like(x.text, '[A-Za-z]'))"
        known = "exists(base, b -> b.start <= x.start AND x.stop <= b.stop)" if k > len(BASE) else "false"
        high = f"exists(split(x.text, '{ALLOW_WITHIN}', -1), w -> {exceeds('w', c.alphabet, c.bound, window)})"
        names.append(f"filter({spans(text, c.pattern, k)}, x -> CASE WHEN {plain} OR regexp_like(x.text, '{ALLOW_WHOLE}') OR {known} THEN false ELSE {high} END)")
    found = rows.withColumn("entropy", F.expr(f"array_sort(concat({', '.join(names)}))"))
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in RESULTS], F.col("base").alias(RESULTS[0]), F.col("entropy").alias(RESULTS[1]))


RESULTS = ("base_spans", "entropy_spans")


def span_text(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{x.name}'" for x in (*BASE, *CLASSES))
    return F.expr(f"array_join(transform({column}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.stop)), ',')")
