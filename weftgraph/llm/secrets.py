"""Operator 10, secret scans: patterns, and structural confirmation of encoded candidates.

Three base patterns report as they match. Beyond them, runs of base64 (wrapped ones too) or hexadecimal characters and
armoured blocks are decoded, and are reported only if what they hold parses: a DER sequence whose
nested lengths add up and which starts like a private key, an OpenSSH key blob whose length-prefixed
fields fit, or a signed token whose header is JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

# The base patterns, the least lengths, and the kinds in the order of reports.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "armour", "der", "openssh", "jws")

_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?:\s|\\+[nrt])*[A-Za-z][A-Za-z-]*:\x20[^\n\\]*(?:\r?\n|(?:\\+r)?\\+n))*)((?:[A-Za-z0-9+/=\s]|\\+[nrt])+)-----END \1-----")
#: What stands before the body of a legacy encrypted key: how, and the initial vector.
_LEGACY = re.compile(r"Proc-Type:\x204,ENCRYPTED[\s\S]*DEK-Info:\x20[A-Z0-9-]+,([0-9A-Fa-f]+)")
#: Object identifiers under which a key is wrapped by a password: PKCS 5, PKCS 12.
_BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_JWS = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
# after a literal \n, \r or \t a run starts at the next character
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?<!\\)|(?![nrt]))[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])|(?<=\\[nrt])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])")
#: A further line of wrapped base64; line ends may be literal escapes.
_NEXT = re.compile(r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\+r)?\\+n)([A-Za-z0-9+/_-]+)(={0,2})(?![A-Za-z0-9+/_=-])")
_HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-"]] = True
_HEXRUN = np.zeros(256, dtype=bool)
_HEXRUN[[*b"0123456789abcdef"]] = True


def _long_runs(marks: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` marks in a row start."""
    have, out = 1, marks
    while have < n:
        step = min(have, n - have)
        out = out[: len(out) - step] & out[step:] if len(out) > step else out[:0]
        have += step
    return np.flatnonzero(out)


def _decode(text: str) -> bytes | None:
    body = re.sub(r"\s|\\+[nrt]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The (tag, start, end) of the elements between ``at`` and ``end``, or None if lengths don't add up."""
    out = []
    while at < end:
        if at + 2 > end or depth > 8:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size == 0x80 or size > 0x84:
            return None
        if size > 0x80:
            k = size & 0x7F
            if at + k > end:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + size > end:
            return None
        if tag & 0x20 and _der(data, at, at + size, depth + 1) is None:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One sequence over all of the data, starting with a small version number, then key material; or a key wrapped by a password."""
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _der(data, top[0][1], top[0][2])
    if parts and [t for t, _, _ in parts] == [0x30, 0x04] and parts[1][2] - parts[1][1] >= 32:
        how = _der(data, parts[0][1], parts[0][2])
        return bool(how) and how[0][0] == 0x06 and data[how[0][1] : how[0][2]].startswith(_BY_PASSWORD)
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    tags = [t for t, _, _ in parts]
    numbers = len(parts) >= 6 and all(t == 0x02 for t in tags[1:6])  # RSA, DSA
    wrapped = tags[1] == 0x30 and tags[2] == 0x04  # PKCS 8: algorithm, octets
    curve = tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16  # SEC 1
    return numbers or wrapped or curve


def is_openssh_key(data: bytes) -> bool:
    """The container of OpenSSH's private keys, whose length-prefixed fields fit."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 0
    while at < len(data):
        if strings == 3:  # the number of keys
            at += 4
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        strings += 1
    return at == len(data) and strings >= 5


def _wrapped(text: str, start: int, end: int) -> tuple[str, int] | None:
    """The kind and the end of a key whose base64 begins in the run ``start`` to ``end`` and goes on in further lines."""
    head = _decode(text[start : start + 20])
    if not head:
        return None
    if head[0] == 0x30 and head[1] > 0x80 and head[1] <= 0x84:  # its length tells how many characters there are
        k = head[1] & 0x7F
        need = -(-(2 + k + int.from_bytes(head[2 : 2 + k], "big")) * 4 // 3)
    elif head == b"openssh-key-v1\x00":
        need = 0
    else:
        return None
    have, width = end - start, end - start
    while (not need or have < need) and (m := _NEXT.match(text, end)):
        have, end = have + len(m[1]), m.end()
        if not need and is_openssh_key(_decode(text[start:end]) or b""):
            return "openssh", end
        if m[2] or len(m[1]) > width:
            break
    return ("der", end) if need == have and is_der_key(_decode(text[start:end]) or b"") else None


def is_token_header(text: str) -> bool:
    data = _decode(text)
    try:
        head = json.loads(data) if data and data[:1] == b"{" else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"] != ""


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the candidates whose structure parses."""
    inside: list[tuple[int, int]] = []
    for m in _ARMOUR.finditer(text):
        data, legacy = _decode(m[3]), _LEGACY.search(m[2])
        whole = legacy and data and len(data) >= 32 and len(data) % (len(legacy[1]) // 2 or 1) == 0  # whole blocks of the cipher
        if data and (whole or is_der_key(data) or is_openssh_key(data)):
            inside.append(m.span())
            yield "armour", *m.span()
    for m in _JWS.finditer(text):
        if is_token_header(m[1]):
            inside.append(m.span())
            yield "jws", *m.span()
    for pattern, decode in ((_BASE64, _decode), (_HEXES, bytes.fromhex)):
        for m in pattern.finditer(text):
            if any(s <= m.start() and m.end() <= e for s, e in inside):
                continue
            data = decode(m[0])
            if data and is_der_key(data):
                yield "der", *m.span()
            elif data and is_openssh_key(data):
                yield "openssh", *m.span()
            elif pattern is _BASE64 and (key := _wrapped(text, *m.span())):
                inside.append((m.start(), key[1]))
                yield key[0], *inside[-1]


def base(text: str, words: bool = True, hexes: bool = True) -> list[tuple[str, int, int]]:
    """Matches of the base patterns; ``words`` and ``hexes``: whether the text can have such at all."""
    out = []
    if words:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def scan_texts(texts: list[bytes]) -> Iterator[list[tuple[str, int, int]]]:
    """Spans of each text by start, then kind; offsets in code points.

    Two tests over the batch tell which texts can match at all: runs of 24 hexadecimal characters
    or 20 that a token or base64 has, found in one pass over its bytes, and the words of the patterns.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    has_hex = np.zeros(len(texts), dtype=bool)
    has_hex[np.searchsorted(ends, _long_runs(_HEXRUN[raw], 24), side="right")] = True
    has_run = np.zeros(len(texts), dtype=bool)
    has_run[np.searchsorted(ends, _long_runs(_RUN[raw], 20), side="right")] = True
    rank = {k: i for i, k in enumerate(KINDS)}
    for t, hexes, run in zip(texts, has_hex.tolist(), has_run.tolist(), strict=True):
        low = t.lower()
        words = any(w in low for w in (b"pass", b"secret", b"token", b"api"))
        deep = run or b"-----BEGIN " in t
        if not (words or hexes or deep or b"AKIA" in t):
            yield []
            continue
        text = t.decode()
        found = base(text, words, hexes)
        if deep:
            found += confirmed(text)
        yield sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with secrets: array of (kind, start, end) by start, then kind.

    Null and empty texts have none; texts are scanned whole, however long; matches of one kind never
    overlap, those of different kinds may (an assigned hexadecimal string is both), ties in start go
    by the order of KINDS; repeated rows are scanned alike; a column named secrets is replaced; an
    empty table gives no rows.
    """
    C.need(docs, "text")
    rest = C.without(docs, "secrets")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    at = next(c for c in rest.columns if c.lower() == "text")
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in C.slices(batches, at, size=8_000_000):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in scan_texts(C.utf8(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.list_(item))], [*b.schema.names, "secrets"])

    return C.map_batches(rest, run, f"{fields}, secrets array<struct<kind:string,start:bigint,end:bigint>>")
