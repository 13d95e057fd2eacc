"""Operator 5, language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else is a space; n-grams of one to three characters are hashed into a
fixed number of buckets. Fitting counts them for each language on a bounded sample of labelled rows
(``per_language`` documents, drawn by a hash of doc_id and text); the matrix of log probabilities has
a fixed bound (``max_floats``) and is broadcast: the more languages, the fewer buckets. Scoring turns a batch into one
sparse matrix of (document, bucket) counts and multiplies it with the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text whose n-grams are in memory at once: each takes some 50 bytes, three start at a character.
SLICE = 500_000
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def grams(texts: list[str], bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a batch, and which documents have a letter.

    Texts are set apart by spaces; n-grams of spaces alone are left out.
    """
    parts = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    cp = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4") if parts else np.zeros(0, "<u4")
    letter = _letters()[cp]
    doc = np.repeat(np.arange(len(parts)), lengths)
    c = np.where(letter, cp, 32).astype(np.uint32)
    has = np.zeros(len(parts), dtype=bool)
    has[doc[letter]] = True
    docs, buckets = [], []
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, dtype=np.uint32)
        some = np.zeros(len(h), dtype=bool)
        for k in range(n):
            h = (h ^ c[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some |= letter[k : k + len(h)]
        some &= doc[: len(h)] == doc[n - 1 :]
        docs.append(doc[: len(h)][some])
        buckets.append((h[some] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.uint32), has


@dataclass
class NaiveBayes:
    languages: list[str]
    log_prob: np.ndarray  #: buckets x languages, float32
    prior: np.ndarray
    bits: int
    orders: tuple[int, ...]
    evidence: int  #: a text's log likelihood counts as that of so many n-grams at most

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        docs, buckets, has = grams(texts, self.bits, self.orders)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        key, n = np.unique((docs << self.bits) | buckets, return_counts=True)  # the batch as a sparse matrix, by row
        row = key >> self.bits
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if len(key):
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            at = row[start]
            total[at] = np.add.reduceat(self.log_prob[key & ((1 << self.bits) - 1)] * n[:, None], start, axis=0)
            seen[at] = np.add.reduceat(n, start)
        total = self.prior + total * np.minimum(1, self.evidence / np.maximum(seen, 1))[:, None]
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, p.max(axis=1), 0.0)


def fit(docs: DataFrame, train: Column, per_language: int = 2000, max_floats: int = 1 << 24, bits: int = 16, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5, evidence: int = 300) -> NaiveBayes:
    """Fit on rows of ``docs`` (doc_id, text, lang) where ``train`` holds and text and lang are there.

    At most about ``per_language`` documents of each language are read, drawn by a hash of doc_id and
    text; rows that repeat both count once among them. Every lang is learned: 2 ** ``bits`` buckets
    each, or as many fewer as ``max_floats`` / languages allows (two at least). A text's evidence
    counts as that of ``evidence`` n-grams at most, as n-grams of one text are not independent: the
    prediction stays the same, the score does not reach 1 for every long text.
    """
    C.need(docs, "doc_id", "text", "lang")
    rows = docs.where(train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    while bits > 1 and len(sizes) << bits > max_floats:
        bits -= 1
    languages = sorted(sizes)
    span = 1 << 30
    number = {name: k for k, name in enumerate(languages)}
    shares = docs.sparkSession.createDataFrame([(name, k, min(span, -(-per_language * span // sizes[name]))) for name, k in number.items()], "lang string, k int, share bigint")
    drawn = rows.where(F.col("text").isNotNull()).join(F.broadcast(shares), "lang")  # a row a language
    drawn = drawn.where(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample")), F.lit(span)) < F.col("share"))
    sample = drawn.groupBy("doc_id", "text", "k").agg(F.lit(1)).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, size=SLICE):
            doc, bucket, _ = grams(b.column("text").to_pylist(), bits, orders)
            which = b.column("k").to_numpy()[doc]
            key, n = np.unique((which.astype(np.int64) << bits) | bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> bits).astype(np.int32)), pa.array((key & ((1 << bits) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "bucket", "n"])

    # at most max_floats rows
    counts = C.map_batches(sample, count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << bits, len(languages)), alpha)
    if counts.num_rows:
        table[counts.column("bucket").to_numpy(), counts.column("k").to_numpy()] += counts.column("n").to_numpy()
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / max(1, sum(sizes.values())))
    return NaiveBayes(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table, prior, bits, orders, evidence)


def identify(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """``docs`` (text, ...) with lang_pred and score for each row.

    lang_pred is one of the model's languages, or ``und`` with score 0 for a null text, one without a
    letter, or a model without languages; score is the posterior probability of lang_pred. Long texts
    are read whole; repeated rows score alike; of tied languages the first by name wins; columns named
    lang_pred or score are replaced; an empty table gives no rows. Only ``text`` is looked at.
    """
    C.need(docs, "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = C.without(docs, "lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    text = next(c for c in rest.columns if c.lower() == "text")

    def run(batches):
        for b in C.slices(batches, text, size=SLICE):
            names, score = held.value.score([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return C.map_batches(rest, run, f"{fields}, lang_pred string, score double")
