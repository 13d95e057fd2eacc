"""Operator 9, quality classifier: a factorisation machine.

Features are hashed words (log counts, scaled to unit length), structure statistics of the text
(shares and repetition, each in a one-hot bin) and the length its metadata state (``n_chars``, in
bins). Every feature has a weight and a low-rank vector; the pairwise term is computed in linear
time as half of (sum of v x) squared less the sum of (v x) squared. The machine is fitted with
AdaGrad on a bounded sample of labelled rows (``max_rows``) and broadcast; its size is fixed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 16
BINS = 12
STATS = 12
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")
_STOPS = re.compile(rb"[.!?]")
_HASHED: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    k = _HASHED.get(w)
    if k is None:
        if len(_HASHED) > 500_000:
            _HASHED.clear()
        k = _HASHED[w] = zlib.crc32(w) & ((1 << BITS) - 1)
    return k


def _bin(x: float) -> int:
    return min(BINS - 1, max(0, int(x)))


def _stats(t: bytes, words: list[bytes], n_chars: int) -> list[int]:
    """The bin of each structure statistic, and of the length in the metadata."""
    n, size = max(1, len(words)), max(1, len(t))
    lines = t.split(b"\n")
    share = lambda x: _bin(0 if x <= 0 else math.log2(x * 4096))
    return [
        _bin(math.log2(len(words) + 1)),
        _bin(len(t) / n),
        share(len(_SYMBOLS.findall(t)) / n),
        share(len(_UPPER.findall(t)) / size),
        share(len(_DIGIT.findall(t)) / size),
        share(t.count(b"!") / n),
        share(t.count(b"|") / n),
        share(len(_STOPS.findall(t)) / n),
        _bin(BINS * len(set(words)) / (n + 1)),
        share(1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)),
        _bin(math.log2(len(lines))),
        _bin(math.log2(n_chars + 1)),
    ]


def features(texts: list[bytes], sizes: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of a batch, by document and feature. Every document has STATS rows at least."""
    words, stat = [], []
    for t, n in zip(texts, sizes, strict=True):
        w = t.split()
        words.append(np.fromiter(map(_word, w), dtype=np.int64, count=len(w)))
        stat.append(_stats(t, w, len(t) if n is None or n < 0 else n))
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    key, count = np.unique((doc << BITS) | np.concatenate([np.zeros(0, np.int64), *words]), return_counts=True)
    doc, value = key >> BITS, 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    value = value / norm[doc]
    s_doc = np.repeat(np.arange(len(texts)), STATS)
    s_key = (1 << BITS) + np.tile(np.arange(STATS) * BINS, len(texts)) + np.array(stat, dtype=np.int64).reshape(-1)
    doc, feat, value = np.r_[doc, s_doc], np.r_[key & ((1 << BITS) - 1), s_key], np.r_[value, np.full(len(s_doc), 0.5)]
    order = np.argsort(doc, kind="stable")
    return doc[order], feat[order], value[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  #: features
    factor: np.ndarray  #: features x rank

    def raw(self, doc: np.ndarray, feat: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        start = np.searchsorted(doc, np.arange(n))
        vx = self.factor[feat] * value[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        return self.bias + np.add.reduceat(self.weight[feat] * value, start) + 0.5 * (s * s - np.add.reduceat(vx * vx, start, axis=0)).sum(axis=1)

    def score(self, texts: list[bytes], sizes: list[int | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts, sizes), len(texts)).astype(np.float64), -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 6, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, one example (features, values, label) at a time."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + STATS * BINS
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    gw, gv, gb, bias = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32), 1e-2, 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)).tolist():
            f, x, y = examples[i]
            vf, xc = v[f], x[:, None]
            s = (vf * xc).sum(axis=0)
            raw = bias + float(w[f] @ x) + 0.5 * float((s * s - ((vf * xc) ** 2).sum(axis=0)).sum())
            g = 1 / (1 + math.exp(-min(30, max(-30, raw)))) - y
            dw = g * x + decay * w[f]
            dv = g * (xc * s - vf * xc * xc) + decay * vf
            gw[f] += dw * dw
            gv[f] += dv * dv
            gb += g * g
            w[f] -= rate * dw / np.sqrt(gw[f])
            v[f] -= rate * dv / np.sqrt(gv[f])
            bias -= rate * g / math.sqrt(gb)
    return Machine(bias, w, v)


def _sizes(b: pa.RecordBatch) -> list[int | None]:
    return b.column("n_chars").to_pylist()


def _inputs(docs: DataFrame) -> Column:
    have = {c.lower() for c in docs.columns}
    return (docs["n_chars"].cast("bigint") if "n_chars" in have else F.lit(None).cast("bigint")).alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, max_rows: int = 8000, max_features: int = 2048) -> Machine:
    """Fit on the rows of ``labels`` (doc_id, ``label``) where ``train_on`` (over doc_id) holds.

    About ``max_rows`` labelled documents are read at most, drawn by a hash of doc_id, and of each at
    most ``max_features`` features, drawn by a hash of the feature, so that what the driver gets is
    bounded by 12 bytes times both, however long the texts. Null labels and ids are left out; of
    labels that contradict each other for one document the smallest counts, and of rows that repeat a
    doc_id one (the smallest by label and features).
    """
    C.need(docs, "doc_id", "text")
    C.need(labels, "doc_id", label)
    usable = labels.where(train_on & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    n, span = usable.count(), 1 << 30
    taken = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(span)) < min(span, -(-max_rows * span // max(1, n))))
    taken = taken.groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = docs.select("doc_id", "text", _inputs(docs)).join(F.broadcast(taken), "doc_id")  # bounded by max_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, size=1_000_000):
            doc, feat, value = features(C.utf8(b.column("text")), _sizes(b))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            if (np.diff(cut) > max_features).any():
                mixed = (feat * 0x9E3779B1) & 0xFFFFFFFF
                order = np.lexsort((mixed, doc))
                taken = np.sort(order[np.arange(len(doc)) - cut[doc[order]] < max_features])
                doc, feat, value = doc[taken], feat[taken], value[taken]
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            cut = cut.tolist()
            f = [feat[s:e].astype("<u4").tobytes() for s, e in zip(cut, cut[1:], strict=False)]
            x = [value[s:e].astype("<f4").tobytes() for s, e in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(f, pa.binary()), pa.array(x, pa.binary())], ["doc_id", "y", "f", "x"])

    made = C.map_batches(rows, run, f"doc_id {C.sql_type(docs, 'doc_id')}, y int, f binary, x binary")
    got = made.groupBy("doc_id").agg(F.min(F.struct("y", "f", "x")).alias("m")).select("doc_id", "m.y", "m.f", "m.x").toArrow().sort_by("doc_id")
    return train([(np.frombuffer(f, "<u4").astype(np.int64), np.frombuffer(x, "<f4"), int(y > 0)) for y, f, x in zip(*(got.column(c).to_pylist() for c in ("y", "f", "x")), strict=True)])


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``docs`` (text, ...) with the column score: the probability of label 1.

    Null and empty texts score as texts without words; a null or missing n_chars stands for the
    text's own size; long texts are read whole; repeated rows score alike; a model fitted on no rows
    scores near 0.5; a column named score is replaced; an empty table gives no rows. Of the other
    columns only n_chars is looked at.
    """
    C.need(docs, "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = C.without(docs, "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    text = next(c for c in rest.columns if c.lower() == "text")
    chars = next((c for c in rest.columns if c.lower() == "n_chars"), None)

    def run(batches):
        for b in C.slices(batches, text, size=1_000_000):
            sizes = b.column(chars).to_pylist() if chars else [None] * b.num_rows
            s = held.value.score(C.utf8(b.column(text)), sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return C.map_batches(rest, run, f"{fields}, score double")
