"""Operator 4, line dedup: drop lines that many documents hold.

Lines are keyed by their normalised form, hashed to 128 bits, and counted by distinct document;
lines of keys over the threshold are dropped everywhere but in the smallest document that holds
them, and each document is put together again by line position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The normalised line, or None if it is too short to be judged."""
    k = line.strip().lower()  # bytes: U+0020 and U+0009 to U+000D; A-Z
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode()) < min_chars:
        return None
    return k


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in C.slices(batches):
        at, out = [], []
        for i, text in enumerate(C.utf8(b.column("text"))):
            keys = {k for k in (_key(x, min_chars) for x in text.split(b"\n")) if k is not None}
            at.extend([i] * len(keys))
            out.extend(xxhash.xxh3_128_digest(k) for k in keys)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("row").take(at), pa.array(out, pa.binary())], ["doc_id", "row", "key"])


def _kept(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in C.slices(batches, "__text"):
        texts, totals, gone = [], [], []
        for text, drop in zip(C.utf8(b.column("__text")), b.column("__drop").to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = lines
            if drop:
                drop = set(drop)
                kept = [x for x in lines if (k := _key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in drop]
            texts.append(b"\n".join(kept))
            totals.append(len(lines))
            gone.append(len(lines) - len(kept))
        rest = [n for n in b.schema.names if n not in ("__text", "__drop")]
        cols = [*(b.column(n) for n in rest), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [*rest, "text", "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` less its repeated lines, and n_lines, n_dropped.

    A key of ``min_chars`` code points or more in ``min_docs`` documents or more loses all its lines
    outside the smallest doc_id that holds it; there all of them stay. Null and empty texts are one
    empty line and come back empty. Rows that repeat a doc_id are one document for the counts, and
    each loses the same keys. A null doc_id counts as one more document, after all others. Long
    texts are split as a whole. Columns of ``docs`` named n_lines or n_dropped are replaced; an
    empty table gives no rows. A document whose last line goes keeps an empty text.
    """
    C.need(docs, "doc_id", "text")
    kind = C.sql_type(docs, "doc_id")
    # of rows that share a doc_id, or have none, each gets the keys of its own text only (by 64 bits of
    # it: were two alike, each would get the other's keys too, which none of its lines has)
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = C.map_batches(docs.select("doc_id", row.alias("row"), "text"), lambda it: _hashes(it, min_chars), f"doc_id {kind}, row bigint, key binary")
    keyed = C.materialise(keyed, "lines")
    # distinct documents first, dealt by (key, document): a line that every document holds is no hot group
    found = keyed.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.sum("one").alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written first: beside a plain shuffle, the rows of a line that is everywhere can be split in the join
    found = C.materialise(found.select("key", "keeper"), "repeated")
    doomed = keyed.join(found.select("key", "keeper"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = doomed.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("key").alias("__drop"))  # bounded by a text's own lines
    rest = [c for c in C.without(docs, "text", "n_lines", "n_dropped").columns]
    joined = docs.join(drops, (row == drops["__row"]) & docs["doc_id"].eqNullSafe(drops["__id"]), "left").select(*[docs[f"`{c}`"] for c in rest], docs["text"].alias("__text"), "__drop")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    out = C.map_batches(joined, lambda it: _kept(it, min_chars), f"{fields}, text string, n_lines bigint, n_dropped bigint")
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[out["text"].alias(c) if c.lower() == "text" else out[f"`{c}`"] for c in order], "n_lines", "n_dropped")
