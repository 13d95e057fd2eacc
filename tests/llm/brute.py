"""Plain versions of the training-data operators, for tests: one loop over a list of rows each."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_rules(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def quality_rules(rows: list[tuple], n_common: int, word_limit: float = 0.05, class_limit: float = 0.08):
    """(doc_id, n_words, word divergence, class divergence, kept) of each (doc_id, text, lang)."""
    import regex

    classes = [r"[A-Z]", r"[0-9]", r"[.,;:]", r"[!?]", r"[#*$%&|<>]", r"[\x20\x09-\x0D]"]
    counted = []
    for k, t, lang in rows:
        t = t or ""
        tokens = [x for x in re.split(r"[\x20\x09-\x0D.,;:!?]+", t.lower()) if x]
        cells = [len(re.findall(c, t)) for c in classes]
        counted.append((k, t, lang, tokens, [*cells, len(t) - sum(cells)]))
    refs = []
    for lang in {c[2] for c in counted if c[2] is not None}:
        own = [c for c in counted if c[2] == lang]
        words, total = Counter(w for c in own for w in c[3]), sum(len(c[3]) for c in own)
        cells = [sum(x) for x in zip(*(c[4] for c in own), strict=True)]
        common = sorted(((-n, w) for w, n in words.items() if regex.fullmatch(r"\p{L}+", w)))[:n_common]
        if total:
            refs.append(({w: -n / total for n, w in common}, [max(x / max(1, sum(cells)), 1e-12) for x in cells]))
    for k, t, _, tokens, cells in counted:
        n, tokens_n, own = base_rules(t)[0], max(1, len(tokens)), Counter(tokens)
        word = []
        for shares, _ in refs:
            p, q = [own[w] / tokens_n for w in shares], list(shares.values())
            word.append(divergence([*p, max(0, 1 - sum(p))], [*q, max(1e-12, 1 - sum(q))]))
        w = min(word) if tokens else 1.0
        c = min(divergence([x / max(1, sum(cells)) for x in cells], q) for _, q in refs) if n else 1.0
        allowed = word_limit + 1.25 * n_common / (8 * math.log(2)) / tokens_n
        yield k, n, round(w, 6), round(c, 6), not base_rules(t)[-1] and w <= allowed and c <= class_limit


def fingerprint(text: str | None, n: int = 3) -> int:
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(ids: list, prints: list[int], bits: int = 3) -> dict:
    """index -> smallest id of its component, by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(prints))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for k, f in zip(ids, prints, strict=True):
        r = find(f)
        if k is not None and (least.get(r) is None or k < least[r]):
            least[r] = k
        least.setdefault(r, None)
    return {i: least[find(f)] for i, f in enumerate(prints)}


def line_dedup(rows: list[tuple], min_chars: int = 10, min_docs: int = 2) -> list[tuple]:
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            holders[ascii_lower(line.strip(space))].add(k)
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = ascii_lower(line.strip(space))
            known = [x for x in holders[key] if x is not None]
            if len(key) >= min_chars and len(holders[key]) >= min_docs and k != min(known):
                continue
            kept.append(line)
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def passages(rows: list[tuple], window: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text: str | None) -> list[tuple]:
    t = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def plain_words(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(text: str | None, n: int = 5) -> set:
    w = plain_words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def contained(docs: list[tuple], items: list[tuple], percent: int = 80) -> dict:
    out = {}
    for k, item in items:
        size = min(5, len(plain_words(item)))
        s = shingles(item, size) if size else set()
        for d, t in docs if s else ():
            n = len(s & shingles(t, size))
            if 100 * n >= percent * len(s):
                out[d, k] = max(out.get((d, k), (0, 0)), (n, len(s)), key=lambda x: x[0] / x[1] if x[1] else 0)
    return out


def tokens(text: str | None, tokenizer) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def divergence(p: list[float], q: list[float]) -> float:
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return (part(p) + part(q)) / 2


def bucket(doc_id, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus
