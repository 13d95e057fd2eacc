"""Operator 3, near-duplicates by SimHash: segment-popcount embedding and a grid range join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance
of two such vectors is never above the fingerprints' Hamming distance, so fingerprints that link at
``max_bits`` = 3 lie within Manhattan distance 3, and within 1 in one of the two halves of 16
segments. The grid cells are the vectors of a half: a fingerprint is at home in two cells and probes
the cells one step up in each segment, so that every pair within distance 1 in a half meets where
one of them is at home. Cells with a single fingerprint go; crowded cells are cut into blocks, and
blocks meet pairwise, each emitting a spanning forest of its links instead of its pairs. Pairs that
the bound lets pass are verified by exact Hamming distance.

Copies collapse to one fingerprint before anything is joined; components are found by alternating
large-star and small-star rounds on DataFrames, never on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fingerprints of a crowded cell that one block holds.
BLOCK = 2048
_LOW = np.uint32(0x55555555)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in lists of about ``step`` bytes."""
    if len(text) <= step:  # bytes: A-Z only; white space is U+0020 and U+0009 to U+000D
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + step)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of the ``words``-word shingles.

    A long text's words are in memory a part at a time.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for part in _words(text):
        w = tail + part
        tail = w[1 - words :] if words > 1 else []
        if len(w) < words:
            continue
        h = np.fromiter((digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)), strict=False)), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n:
        return digest(b" ".join(tail), 42) if tail else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    kind = C.sql_type(docs, "doc_id")

    def run(batches):
        for b in C.slices(batches):
            fp = np.array([fingerprint(t, words) for t in C.utf8(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return C.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def _segments(half: np.ndarray) -> np.ndarray:
    """The bit counts of a half's 16 two-bit segments, two bits each."""
    return half - ((half >> np.uint32(1)) & _LOW)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys, fps, home = [], [], []
        for side in (0, 1):
            at = _segments(((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            for step in range(-1, 16):
                if step < 0:
                    ok, key = slice(None), at
                else:
                    ok = ((at >> np.uint32(2 * step)) & np.uint32(3)) < 2
                    key = at[ok] + np.uint32(1 << (2 * step))
                keys.append(key.astype(np.int64) | (side << 32))
                fps.append(fp[ok].view(np.int64))
                home.append(np.full(len(key), step < 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(home))], ["cell", "fp", "home"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment counts of whole fingerprints."""
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.int16)
    for side in (0, 32):
        x, y = (_segments(((v >> np.uint64(side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)) for v in (a, b))
        for k in range(0, 32, 2):
            out += np.abs(((x >> np.uint32(k)) & np.uint32(3)).astype(np.int8) - ((y >> np.uint32(k)) & np.uint32(3)).astype(np.int8))
    return out


def _forest(a: np.ndarray, n_home: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest linked fingerprint of its group) among a cell's rows.

    The first ``n_home`` are at home; pairs of two probes meet elsewhere.
    """
    label = np.arange(len(a))
    near = []
    for lo in range(0, n_home, 256):
        rows = a[lo : lo + 256, None]
        near.append(np.argwhere(_distance(rows, a[None, :]) <= max_bits) + [lo, 0])
    i, j = np.concatenate(near).T
    keep = i != j
    i, j = i[keep], j[keep]
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(a))
    return a[linked], a[label[linked]]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell, fp, home):
            """Links of whole groups (rows sorted by cell and task, those at home first)."""
            out_a, out_b = [], []
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            size = ends - starts
            two = starts[size == 2]
            two = two[home[two]]
            x, y = fp[two], fp[two + 1]
            ok = _apart(x, y) <= max_bits  # the lower bound
            ok[ok] = _distance(x[ok], y[ok]) <= max_bits
            out_a.append(x[ok])
            out_b.append(y[ok])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                n = int(home[s:e].sum())
                if n:
                    p, q = _forest(fp[s:e], n, max_bits)
                    out_a.append(p)
                    out_b.append(q)
            p, q = np.concatenate(out_a), np.concatenate(out_b)
            swap = p.view(np.int64) > q.view(np.int64)
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], ["a", "b"])

        held = None
        for b in batches:
            cell = np.stack([b.column("cell").to_numpy(), b.column("task").to_numpy()], axis=1)
            _, key = np.unique(cell, axis=0, return_inverse=True)
            now = (cell, b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False))
            if held:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1))[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
            held = tuple(x[last:] for x in now)
            if last:
                yield found(_runs(now[0][:last]), now[1][:last], now[2][:last])
        if held and len(held[1]):
            yield found(_runs(held[0]), held[1], held[2])

    return run


def _runs(cell: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    return np.cumsum(np.r_[False, (cell[1:] != cell[:-1]).any(axis=1)])


def links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Rows (a, b), a < b, of verified links that connect what links connect, of distinct ``fps`` (fp)."""
    if max_bits > 3:
        raise ValueError("two halves within distance 1 cover at most 3 bits")
    n = C.partitions(fps.sparkSession)
    cells = C.map_batches(fps.select("fp"), _cells, "cell bigint, fp bigint, home boolean")
    sizes = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("probes"))
    # written first, here and below: beside a plain scan, the rows of a hot key can be split in the join
    live = C.materialise(sizes.where("homes > 0 and homes + probes > 1"), "cells")
    rows = cells.join(live, "cell")
    # a block of rows at home meets each block; of probes, each block at home
    hb, pb = F.ceil(F.col("homes") / block), F.ceil(F.col("probes") / block)
    rows = rows.withColumn("hb", hb.cast("int")).withColumn("pb", pb.cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("pb")).cast("bigint")).cast("int")
    rows = rows.withColumn("mine", mine)
    whole = (F.col("hb") == 1) & (F.col("pb") <= 1)
    other = F.sequence(F.lit(0), F.col("hb") - 1)
    among = F.transform(other, lambda k: (F.least(k, F.col("mine")) * 65_536 + F.greatest(k, F.col("mine"))).cast("bigint"))
    probed = F.transform(F.sequence(F.lit(1), F.greatest("pb", F.lit(1))), lambda k: (-(F.col("mine") * F.lit(65_536).cast("bigint")) - k).cast("bigint"))
    probing = F.transform(other, lambda k: (-(k * F.lit(65_536).cast("bigint")) - F.col("mine") - 1).cast("bigint"))
    tasks = F.when(whole, F.array(F.lit(0).cast("bigint"))).when(F.col("home") & (F.col("pb") > 0), F.concat(among, probed)).when(F.col("home"), among).otherwise(probing)
    dealt = rows.select("cell", F.explode(tasks).alias("task"), "fp", "home").repartition(n, "cell", "task").sortWithinPartitions("cell", "task", F.desc("home"), "fp")
    return C.map_batches(dealt, _links(max_bits), "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node it reaches.

    Alternating large-star and small-star rounds; each round's edges are written to the shared
    folder. Minima are aggregated by partition and written before they are joined back, so that a hub
    is no group and its edges can be split among tasks.
    """
    now = C.materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for k in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = C.materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), f"low{k}")
        # large star: every larger neighbour goes to the smallest one
        star = C.materialise(both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct(), f"star{k}")
        # small star: a node and its smaller neighbours go to the smallest of these
        down = star.select(F.col("b").alias("n"), F.col("a").alias("s"))
        least = C.materialise(down.groupBy("n").agg(F.min("s").alias("low")), f"least{k}")
        new = down.join(least, "n").select(F.col("low").alias("a"), F.explode(F.array("n", "s")).alias("b")).where("a <> b").distinct()
        new = C.materialise(new, f"edges{k}")
        # done when every node hangs on one root that hangs on nothing
        busy = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        now = new
        if not busy:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id among the documents that links reach, itself included.
    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than
    a shingle has its whole sequence as its only shingle; equal fingerprints link, ties among bits
    (set in exactly half) are zero; repeated rows each come back; a null doc_id takes part, but is
    the component_id only where the component has no other; an empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    C.need(docs, "doc_id", "text")
    of = C.materialise(fingerprints(docs, words), "fingerprints")
    distinct = of.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = C.materialise(components(links(distinct, max_bits)), "roots")
    named = C.materialise(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    lowest = C.materialise(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    class_of = C.materialise(named.join(lowest, "root").select("fp", "component_id"), "classes")
    return of.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
