"""Operator 7, substring dedup: remove passages of ``window`` words that start in two places.

First pass: each batch of documents makes a partition sketch, a count-min sketch of its windows.
Windows are counted by their minimiser, the smallest hash among the 20-word grams inside: equal
windows have equal minimisers, so that a count of minimisers, as one of sketch cells, can only
overestimate that of a window. The sketch is dealt by range of hashes (the ranges grow in number
with the input, each has the same number of counters) and sent as the cells that are not zero; range
by range the partition sketches are added up, and each minimiser is looked up in the sum: where every
counter is two or more, the windows around its places are estimated repeated. None is lost.

Second pass: only those windows are hashed whole (with the minimiser's hash, 128 bits) and grouped
exactly, again by the minimiser's range; those that lie one after another travel as runs. Windows
that repeat within a batch are decided there and sent once, so that no passage, however common, makes
a group larger than the number of batches. A range knows a document by its batch and number; the
batch's table of rows goes along once, and batches that are alike count as often, but are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Cells of a row of a range's sketch, as a power of two; rows of the sketch.
CELL_BITS = 24
DEPTH = 2
#: Minimisers, or windows, that a range should hold.
RANGE = 1 << 20
_KNOWN: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hash(w: bytes) -> int:
    import xxhash

    h = _KNOWN.get(w)
    if h is None:
        if len(_KNOWN) > 300_000:
            _KNOWN.clear()
        h = xxhash.xxh64_intdigest(w, 7)
        if len(w) < 64:
            _KNOWN[w] = h
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values, by doubling."""
    power, have, out, span = h, 1, None, 0
    while True:
        if n & have:
            out, span = (power, have) if out is None else (_mix(out[: len(out) - have] * _M1 + power[span:]) if len(out) > have else out[:0], span + have)
        if have * 2 > n:
            return out
        power = _mix(power[: len(power) - have] * _M1 + power[have:]) if len(power) > have else power[:0]
        have *= 2


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = op(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


class Windows:
    """The windows of a batch of documents, laid out one after another."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.window = window
        n = int(sizes.sum())
        h = np.fromiter((_word_hash(x) for w in self.words for x in w), dtype=np.uint64, count=n)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        self.hash = h
        self.doc = doc
        total = max(0, n - window + 1)
        self.valid = doc[:total] == doc[window - 1 :] if total else np.zeros(0, bool)
        self.gram = _rolled(h, gram) if n >= gram else np.zeros(0, np.uint64)
        self.low = _slide(self.gram, window - gram + 1, np.minimum)[:total]
        self.span = window - gram + 1

    def minimisers(self) -> np.ndarray:
        """Where the grams start that are smallest in some window."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        seen = np.where(self.valid, self.low, np.uint64(0))
        pad = np.zeros(self.span - 1, np.uint64)
        most = _slide(np.r_[pad, seen, pad], self.span, np.maximum)
        some = _slide(np.r_[pad.astype(bool), self.valid, pad.astype(bool)], self.span, np.logical_or)
        return np.flatnonzero(some & (most == self.gram[: len(most)]))


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def _cells(h: np.ndarray) -> list[np.ndarray]:
    x = _mix(h * _M1)
    return [((x >> np.uint64(k * CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32) for k in range(DEPTH)]


def _cut(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    b = bucket[order]
    if len(b):
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(b)], strict=True):
            yield int(b[s]), order[s:e]


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], np.ndarray]]:
    """Rows of each range in turn, from batches sorted by range and batch, and how often each came.

    Rows of batches that are alike come as one; those of negative ranges come a thousand at a time.
    """
    now, rows, times = None, [], []
    for b in batches:
        for r in b.to_pylist():
            if r["range"] != now or now < 0 and len(rows) >= 1000:
                if rows:
                    yield now, rows, np.array(times)
                now, rows, times = r["range"], [], []
            if rows and rows[-1]["batch"] == r["batch"]:
                times[-1] += 1
            else:
                rows.append(r)
                times.append(1)
    if rows:
        yield now, rows, np.array(times)


def _packed(x: np.ndarray, kind: str) -> bytes:
    """The bytes of an array by significance: those that hardly vary lie together and compress away."""
    a = np.ascontiguousarray(x.astype(kind))
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Numbers as differences, small where rows lie in the order of the texts."""
    return _packed(np.diff(x, prepend=0), "<i4")


def _stepped(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, "<i4"), dtype=np.int64)


#: What batches send. Range -2: the batch's table, doc (the number of each row's text) and x (the rows'
#: keys); -1: places that the batch itself found, doc, at, n (how many in a row); others: x and y, hashes.
_MESSAGE = "range int, batch binary, doc binary, at binary, n binary, times binary, x binary, y binary"
#: Kind 0: a batch's table, doc and at as doc and x above; kind 1: places found, doc, at, n.
_ANSWER = "batch binary, kind int, doc binary, at binary, n binary"
KEY_BYTES = 24


class Batch:
    """A batch of documents, each text once, and the messages that it sends."""

    def __init__(self, texts: list[bytes], keys: list[bytes]):
        number: dict[bytes, int] = {}
        self.row_doc = np.array([number.setdefault(t, len(number)) for t in texts], dtype=np.int64)
        self.texts, self.keys = list(number), keys
        self.times = np.minimum(np.bincount(self.row_doc, minlength=len(number)), 2)
        self.id = hashlib.md5(b"".join(keys), usedforsecurity=False).digest()
        self.out: list[tuple] = []

    def send(self, range_: int, doc=b"", at=b"", n=b"", times=b"", x=b"", y=b"") -> None:
        self.out.append((range_, self.id, doc, at, n, times, x, y))

    def messages(self) -> pa.RecordBatch:
        self.send(-2, doc=_packed(self.row_doc, "<u4"), x=b"".join(self.keys))
        names = [f.split(" ")[0] for f in _MESSAGE.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.out, strict=True), kinds, strict=True)], names)


def _sketches(ranges: int, window: int, gram: int):
    """Partition sketches: the cells of each minimiser, once a batch, with the place where it is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, size=4_000_000):
            batch = Batch(C.utf8(b.column("text")), b.column("row").to_pylist())
            w = Windows(batch.texts, window, gram)
            at = w.minimisers()
            if not len(at):
                continue
            h, doc = w.gram[at], w.doc[at]
            place = at - w.first[doc]
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=batch.times[doc])
            i = np.flatnonzero(n[inverse] > 1)  # repeated by the batch's own count
            if len(i):
                batch.send(-1, doc=_steps(doc[i]), at=_steps(place[i]))
            i = np.sort(first)  # in the order of the texts
            times = np.minimum(n[inverse[i]], 2)
            bucket, cells = _range_of(h[i], ranges), _cells(h[i])
            for r, j in _cut(np.argsort(bucket, kind="stable"), bucket):
                batch.send(r, doc=_steps(doc[i[j]]), at=_steps(place[i[j]]), times=_packed(times[j], "u1"), x=b"".join(_packed(x[j], "<u4") for x in cells))
            yield batch.messages()

    return run


def _answered(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _ANSWER.split(", ")])


def _passed_on(r: int, rows: list[dict]) -> pa.RecordBatch:
    """The rows of a negative range as answers."""
    return _answered([(x["batch"], 0, x["doc"], x["x"], b"") if r == -2 else (x["batch"], 1, x["doc"], x["at"], x["n"]) for x in rows])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a range's partition sketches up, and look its minimisers up: the places whose every counter has two or more."""
    counters = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    for r, rows, often in _by_range(batches):
        if r < 0:
            yield _passed_on(r, rows)
            continue
        part = [np.stack([_unpacked(x["x"][k * len(x["x"]) // DEPTH : (k + 1) * len(x["x"]) // DEPTH], "<u4") for k in range(DEPTH)]) for x in rows]
        own = [_unpacked(x["times"], "u1") for x in rows]
        estimate = [np.full(len(n), 2, np.uint32) for n in own]
        for k in range(DEPTH):
            for cells, n, m in zip(part, own, often.tolist(), strict=True):  # the merge
                np.add.at(counters, cells[k], np.minimum(n * np.uint32(m), 2))
            estimate = [np.minimum(e, counters[cells[k]]) for e, cells in zip(estimate, part, strict=True)]
            for cells in part:
                counters[cells[k]] = 0
        out = []
        for x, e, n in zip(rows, estimate, own, strict=True):
            hot = (e >= 2) & (n == 1)  # those with more the batch has told itself
            if hot.any():
                out.append((x["batch"], 1, _steps(_stepped(x["doc"])[hot]), _steps(_stepped(x["at"])[hot]), b""))
        if out:
            yield _answered(out)


def _runs(*columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs start: places one after another that agree in ``columns``."""
    if not len(at):
        return np.zeros(0, np.int64)
    new = at[1:] != at[:-1] + 1
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new])


def _exact(ranges: int, window: int, gram: int):
    """The windows around the places found, hashed whole, as runs of windows with one minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "__text", size=4_000_000):
            batch = Batch(C.utf8(b.column("__text")), b.column("__row").to_pylist())
            w = Windows(batch.texts, window, gram)
            if not w.valid.any():
                continue
            found: dict[int, set[bytes]] = {}
            for d, packed in zip(batch.row_doc.tolist(), b.column("__at").to_pylist(), strict=True):
                found.setdefault(d, set()).update(packed)
            mark = np.zeros(len(w.low), dtype=bool)
            for d, packed in found.items():
                hot = np.unique(w.gram[np.frombuffer(b"".join(packed), "<u4")[::2].astype(np.int64) + w.first[d]])
                s, e = int(w.first[d]), min(int(w.first[d]) + len(w.words[d]), len(w.low))
                part = w.low[s:e]
                i = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
                mark[s:e] = (hot[i] == part) & w.valid[s:e]
            at = np.flatnonzero(mark)
            if not len(at):
                continue
            low, whole, doc = w.low[at], _rolled(w.hash, window)[at], w.doc[at]
            place = at - w.first[doc]
            group = _groups(low, whole)
            n = np.bincount(group, weights=batch.times[doc])
            first = np.full(len(n), len(at))
            np.minimum.at(first, group, np.arange(len(at)))
            i = np.flatnonzero(n[group] > 1)
            if len(i):
                s = _runs(doc[i], at=place[i])
                batch.send(-1, doc=_steps(doc[i][s]), at=_steps(place[i][s]), n=_packed(np.diff(np.r_[s, len(i)]), "<u4"))
            i = np.sort(first)  # in the order of the texts
            times = np.minimum(n[group[i]], 2)
            s = _runs(doc[i], low[i], at=place[i])
            length = np.diff(np.r_[s, len(i)])
            bucket = _range_of(low[i][s], ranges)
            for r, j in _cut(np.argsort(bucket, kind="stable"), bucket):
                k = np.concatenate([np.arange(s[x], s[x] + length[x]) for x in j.tolist()])  # the runs' windows
                batch.send(r, doc=_steps(doc[i][s[j]]), at=_steps(place[i][s[j]]), n=_packed(length[j], "<u4"), times=_packed(times[k], "u1"), x=_packed(low[i][s[j]], "<u8"), y=_packed(whole[i][k], "<u8"))
            yield batch.messages()

    return run


def _groups(low: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    order = np.lexsort((whole, low))
    new = np.r_[True, (low[order][1:] != low[order][:-1]) | (whole[order][1:] != whole[order][:-1])]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group a range's windows exactly: those that more than one place has, as runs."""
    for r, rows, often in _by_range(batches):
        if r < 0:
            yield _passed_on(r, rows)
            continue
        length = [_unpacked(x["n"], "<u4").astype(np.int64) for x in rows]
        low = np.concatenate([np.repeat(_unpacked(x["x"], "<u8"), n) for x, n in zip(rows, length, strict=True)])
        whole = np.concatenate([_unpacked(x["y"], "<u8") for x in rows])
        own = [_unpacked(x["times"], "u1") for x in rows]
        group = _groups(low, whole)
        total = np.bincount(group, weights=np.concatenate([np.minimum(n * m, 2.0) for n, m in zip(own, often.tolist(), strict=True)]))
        hit = (total[group] >= 2) & (np.concatenate(own) == 1)
        out, at = [], 0
        for x, n in zip(rows, length, strict=True):
            size = int(n.sum())
            mine = np.flatnonzero(hit[at : at + size])
            at += size
            if len(mine):
                stop = np.cumsum(n)
                run = np.searchsorted(stop, mine, side="right")
                doc = _stepped(x["doc"])[run]
                place = _stepped(x["at"])[run] + mine - (stop - n)[run]
                s = _runs(doc, at=place)
                out.append((x["batch"], 1, _steps(doc[s]), _steps(place[s]), _packed(np.diff(np.r_[s, len(mine)]), "<u4")))
        if out:
            yield _answered(out)


def _to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at): what was found in each row, from answers sorted by batch and kind.

    at: pairs of 32-bit numbers, a place and how many in a row.
    """

    def told(table: dict, answers: list[dict]) -> pa.RecordBatch:
        doc = np.concatenate([_stepped(x["doc"]) for x in answers])
        at = np.concatenate([_stepped(x["at"]) for x in answers])
        n = np.concatenate([_unpacked(x["n"], "<u4") if x["n"] else np.ones(len(_stepped(x["at"])), "<u4") for x in answers])
        order = np.lexsort((at, doc))
        of = {d: np.stack([at[i], n[i]], axis=1).astype("<u4").tobytes() for d, i in _cut(order, doc)}
        keys, row_doc = table["at"], _unpacked(table["doc"], "<u4").tolist()
        rows = {keys[KEY_BYTES * k : KEY_BYTES * (k + 1)]: of[d] for k, d in enumerate(row_doc) if d in of}
        return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.binary())], ["row", "at"])

    table, answers = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == 0:
                if answers:
                    yield told(table, answers)
                table, answers = r, []
            else:
                answers.append(r)
    if answers:
        yield told(table, answers)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "__text"):
            texts, totals, gone = [], [], []
            for text, found in zip(C.utf8(b.column("__text")), b.column("__at").to_pylist(), strict=True):
                words = text.split()
                kept = words
                if found:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    start, n = np.frombuffer(b"".join(found), "<u4").astype(np.int64).reshape(-1, 2).T
                    np.add.at(step, start, 1)
                    np.subtract.at(step, start + n - 1 + window, 1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]
                texts.append(b" ".join(kept))
                totals.append(len(words))
                gone.append(len(words) - len(kept))
            rest = [n for n in b.schema.names if n not in ("__text", "__at")]
            cols = [*(b.column(n) for n in rest), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*rest, "text", "n_words", "n_removed"])

    return run


def drop_repeated_passages(docs: DataFrame, window: int = 35, gram: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` less its repeated passages, and n_words, n_removed.

    A word goes if it lies in a window of ``window`` words whose sequence also starts at another
    place, in any document, its own included; text is then the words that stay, joined by one space.
    Windows are judged on the input. Null and empty texts, and texts shorter than a window, lose
    nothing (null comes back empty). Rows that repeat are places of their own, so that both lose what
    they share; rows of one doc_id, or of a null doc_id, with different texts are told apart by their
    text. Long texts are taken whole. Columns of ``docs`` named n_words or n_removed are replaced; an
    empty table gives no rows.
    """
    C.need(docs, "doc_id", "text")
    spark = docs.sparkSession
    n = C.partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(n, 64, -(-size // 6 // RANGE))
    docs = C.settled(docs)  # a batch that is made again must be the same
    # rows are told apart by 128 bits of their text; doc_id deals those that share it. Equal texts have equal answers
    # (never null: the filter that an inner join adds would keep its rows from being those of the other join)
    row = F.coalesce(F.concat(C.text_key(), F.unhex(F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0"))), F.lit(b""))
    sketch = C.map_batches(docs.select(row.alias("row"), "text"), _sketches(ranges, window, gram), _MESSAGE)
    spread = F.when(F.col("range") < 0, F.xxhash64("batch")).otherwise(F.lit(0))

    def answered(messages: DataFrame, decide) -> DataFrame:
        dealt = messages.repartition(n, "range", spread).sortWithinPartitions("range", "batch")
        told = C.map_batches(dealt, decide, _ANSWER).repartition(n, "batch").sortWithinPartitions("batch", "kind")
        # a set: what many batches say of a row that repeats is the same
        return C.map_batches(told, _to_rows, "row binary, at binary").groupBy(F.col("row").alias("__row")).agg(F.collect_set("at").alias("__at"))

    rest = C.without(docs, "text", "n_words", "n_removed").columns
    # both joins take the same rows with the same columns, so that the texts are shuffled once
    all_rows = docs.select(*[docs[f"`{c}`"] for c in rest], docs["text"].alias("__text"), row.alias("__row"))
    places = answered(sketch, _estimate)
    exact = C.map_batches(all_rows.join(places, "__row"), _exact(ranges, window, gram), _MESSAGE)
    starts = answered(exact, _decide)
    joined = all_rows.join(starts, "__row", "left").drop("__row")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    out = C.map_batches(joined, _remove(window), f"{fields}, text string, n_words bigint, n_removed bigint")
    order = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    return out.select(*[out["text"].alias(c) if c.lower() == "text" else out[f"`{c}`"] for c in order], "n_words", "n_removed")
