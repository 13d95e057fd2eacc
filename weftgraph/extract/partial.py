"""Broken sources: the parts that parse, and what single broken lines look like."""

from __future__ import annotations

import ast
import re

from . import python_ast

# What a broken line may be, and how sure that is.
_LINES = [
    (re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\(.*\)\s*(?:->.*)?:"), 0.9),
    (re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\("), 0.7),
    (re.compile(r"^\s*(?:async\s+)?def\s+(\w+)"), 0.5),
    (re.compile(r"^\s*class\s+(\w+)\s*(?:\(.*\))?\s*:"), 0.9),
    (re.compile(r"^\s*class\s+(\w+)"), 0.6),
    (re.compile(r"^\s*(?:from\s+\S+\s+)?import\s+(\w+)"), 0.7),
]


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def regions(source: str) -> list[dict]:
    """Regions by halving: (line_start, line_end, status, confidence, names), from line 1."""
    lines = source.split("\n")
    out: list[dict] = []

    def visit(lo: int, hi: int) -> None:
        text = "\n".join(lines[lo:hi])
        if not text.strip():
            return
        if _parses(text):
            names = [e.name for e in python_ast.extract(text)]
            out.append({"line_start": lo + 1, "line_end": hi, "status": "VALID", "confidence": 1.0, "names": names})
        elif hi - lo == 1:
            hit = next(((m[1], c) for p, c in _LINES if (m := p.match(lines[lo]))), None)
            out.append({"line_start": lo + 1, "line_end": hi, "status": "INVALID", "confidence": hit[1] if hit else 0.0, "names": [hit[0]] if hit else []})
        else:
            mid = (lo + hi) // 2
            visit(lo, mid)
            visit(mid, hi)

    visit(0, len(lines))
    return out


def update(old: list[dict], source: str, first: int, last: int) -> list[dict]:
    """Regions of a source whose lines ``first`` to ``last`` changed: those apart from them are kept."""
    kept = [r for r in old if r["line_end"] < first or r["line_start"] > last]
    covered = {n for r in kept for n in range(r["line_start"], r["line_end"] + 1)}
    lines = source.split("\n")
    again = regions("\n".join("" if i + 1 in covered else x for i, x in enumerate(lines)))
    return sorted([*kept, *again], key=lambda r: (r["line_start"], r["line_end"]))


def shadow(source: str) -> list[dict]:
    """Entities of a broken source, marked by their hash: (name, confidence, signature_hash)."""
    from .entity import short_hash

    return [{"name": n, "confidence": r["confidence"], "signature_hash": "shadow:" + short_hash(f"{n}:{r['line_start']}")} for r in regions(source) for n in r["names"]]
