"""python -m bytesmith.cli VERB ...: parse, diff, detect, strings, entropy, hints, check and dump for single files.

Exit status: 0 if all is well, 1 for a mismatch or an empty result, 2 for wrong use. --quiet leaves the status alone. Runs the operators' own
functions, without Spark."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators.analysis import entropies, find_strings, hints
from .operators.detect import HEAD, registry
from .operators.diff import changed_runs
from .operators.parse import count_failed, entry_of, outcome_json, program, tree_text
from .plans.interpreter import Stop, coverage_of, leaf_spans
from .plans.language import SchemaError, parse_schema
from .plans.metadata import order_name


VERSION = "0.2.0"


def number(text: str) -> int:
    """Decimal, or hex with 0x; underscores may part digits."""
    return int(text.replace("_", ""), 16 if text.lower().startswith("0x") else 10)


def _region(a: argparse.Namespace) -> tuple[bytes, int, int]:
    data = Path(a.file).read_bytes()
    at = min(a.at or 0, len(data))
    return data[at : len(data) if a.len is None else min(len(data), at + a.len)], at, len(data)


def parse(a: argparse.Namespace) -> int:
    text = Path(a.schema).read_text()
    entry, endian = entry_of(text, a.entry, order_name(a.endian) if a.endian else None)
    o = program(text).run(Path(a.file).read_bytes(), entry, endian)
    cover = coverage_of(leaf_spans(o.tree), o.total)
    fraction = cover["covered"] / cover["total"] if cover["total"] else 1.0
    if not a.quiet:
        print(outcome_json(o) if a.json else tree_text(o.tree))
    told = (lambda *x, **y: None) if a.quiet else print
    if o.fault:
        told(f"fault at {o.fault.path}, offset {o.fault.offset}: {o.fault.message} ({o.fault.kind})", file=sys.stderr)
        return 1
    if bad := count_failed(o.tree):
        told(f"{bad} checksums don't match", file=sys.stderr)
        return 1
    if a.min_coverage is not None and fraction * 100 < a.min_coverage:
        told(f"{fraction:.1%} covered", file=sys.stderr)
        return 1
    return 0


def diff(a: argparse.Namespace) -> int:
    left, right = Path(a.file).read_bytes(), Path(a.other).read_bytes()
    runs, changed = changed_runs(left, right)
    if a.quiet:
        return int(bool(changed) or len(left) != len(right))
    if a.json:
        print(json.dumps({"left": len(left), "right": len(right), "changed": changed, "runs": [{"offset": o, "len": n} for o, n in runs[: a.limit]]}))
    else:
        for o, n in runs[: a.limit]:
            print(f"{o:#x} +{n}: {left[o : o + min(n, 16)].hex(' ')} -> {right[o : o + min(n, 16)].hex(' ')}")
    return int(bool(changed) or len(left) != len(right))


def detect(a: argparse.Namespace) -> int:
    head = Path(a.file).read_bytes()[:HEAD]
    found = [s for s in registry() if all(head[o : o + len(h) // 2] == bytes.fromhex(h) for o, h in s["parts"])]
    found.sort(key=lambda s: (-s["confidence"], -s["magic_bytes"], s["ordinal"]))
    _show(a, [{k: s[k] for k in ("format", "extension", "confidence", "description")} for s in found])
    return int(not found)


def strings(a: argparse.Namespace) -> int:
    data, at, _ = _region(a)
    found = [{"offset": at + o, "size": n, "encoding": e, "text": t} for o, n, e, t in find_strings(data, a.min)]
    _show(a, found)
    return int(not found)


def entropy(a: argparse.Namespace) -> int:
    data, at, _ = _region(a)
    found = entropies(data, max(1, a.buckets))
    if found and a.json:
        print(json.dumps({"offset": at, "len": len(data), "bucket_bytes": len(data) // len(found), "values": [round(v, 6) for v in found]}))
    elif found:
        peak = max(range(len(found)), key=lambda i: (found[i], i))
        _show(a, [{"bucket": i, "entropy": round(v, 6)} for i, v in enumerate(found)])
        if not a.quiet:
            print(f"mean {sum(found) / len(found):.4f}, peak {found[peak]:.4f} in bucket {peak}" + (", looks packed" if found[peak] > 0.95 else ""))
    return int(not found)


def shape(a: argparse.Namespace) -> int:
    data, at, total = _region(a)
    found = [dict(zip(("label", "detail", "offset", "size"), h)) for h in hints(data, at, total)]
    _show(a, found)
    return int(not found)


def check(a: argparse.Namespace) -> int:
    failed = 0
    for path in a.schemas:
        try:
            s = parse_schema(Path(path).read_text())
            if not a.quiet:
                print(f"{path}: {len(s.types)} types")
        except SchemaError as e:
            failed += 1
            if not a.quiet:
                print(f"{path}: {e}", file=sys.stderr)
    return int(bool(failed))


def _show(a: argparse.Namespace, rows: list[dict]) -> None:
    if a.json:
        print(json.dumps(rows, ensure_ascii=False))
    elif not a.quiet:
        for r in rows:
            print("  ".join(str(v) for v in r.values()))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="bytesmith", description=__doc__)
    top.add_argument("-V", "--version", action="version", version=f"bytesmith {VERSION}")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name, run, *, file=True, span=False):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--json", action="store_true")
        p.add_argument("-q", "--quiet", action="store_true")
        if file:
            p.add_argument("file")
        if span:
            p.add_argument("--at", type=number)
            p.add_argument("--len", type=number)
        return p

    for name in ("parse", "dump"):
        p = verb(name, parse)
        p.add_argument("schema")
        p.add_argument("--entry")
        p.add_argument("--endian")
        p.add_argument("--min-coverage", type=float)
    p = verb("diff", diff)
    p.add_argument("other")
    p.add_argument("--limit", type=number, default=20)
    verb("detect", detect)
    verb("strings", strings, span=True).add_argument("--min", type=number, default=4)
    verb("entropy", entropy, span=True).add_argument("--buckets", type=number, default=64)
    verb("hints", shape, span=True)
    verb("check", check, file=False).add_argument("schemas", nargs="+")
    try:
        a = top.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        return a.run(a)
    except (OSError, SchemaError, Stop) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
