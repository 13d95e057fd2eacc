"""Operator 1, best-fit packing: a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The covering program (as few
configurations as possible that hold every piece) is solved by multiplicative weights: a length's
weight falls exponentially with the share of it that is covered, a knapsack dynamic program prices
configurations under those weights, and configurations within ``slack`` of the best price are taken,
priced anew until all but ``enough`` of the tokens are covered. The fractional solution is rounded up
as far as pieces are left, and what then remains goes best-fit into the room of open sequences, in
bulk by length. The driver sees only the histogram (at most ``capacity`` counts); the pieces are ranked
within their length and find their place from the plan by binary search.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_TOKENIZERS: dict[str, tuple] = {}
#: The ids of plain words that a worker remembers, and how many it may.
_WORDS: dict[str, dict[str, bytes]] = {}
CACHED_WORDS = 300_000
#: Letters that no normalisation changes in number, and punctuation that is a word of its own.
_LETTERS, _STOPS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> tuple:
    """The tokenizer; which of its ids end a word; a special token and its id. None for what it does not have."""
    if path not in _TOKENIZERS:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        vocabulary = tok.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        encode = lambda t: tok.encode(t, add_special_tokens=False).ids
        # what the shortcuts below rest on: words of letters end once, case and spaces do not matter,
        # and texts on the two sides of a special token do not touch
        probe = encode("Abcd e\u00c9f")
        marked = probe == encode("abcd") + encode("e\u00e9f") and int(ends[probe].sum()) == 2
        mark = next(((t.content, i) for i, t in sorted(tok.get_added_tokens_decoder().items(), reverse=True) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        if mark and encode(f"a's{mark[0]}'s{mark[0]}{mark[0]}b") != [*encode("a's"), mark[1], *encode("'s"), mark[1], mark[1], *encode("b")]:
            mark = None
        _TOKENIZERS[path] = (tok, ends if marked else None, mark)
    return _TOKENIZERS[path]


def _parts(tok, words: list[str], between: str, step: int, cut) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words encoded many at once, and how many each has; ``cut`` tells where words end in the ids."""
    flat, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for lo in range(0, len(words), step):
        part = words[lo : lo + step]
        ids = np.array(tok.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        ids, n = cut(ids)
        if len(n) != len(part):
            raise ValueError("the tokenizer does not keep words apart")
        flat.append(ids)
        size.append(n)
    return np.concatenate(flat), np.concatenate(size)


def _known_words(path: str, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode`` gives for ``words``, of which a worker remembers some; beyond CACHED_WORDS those last seen twice."""
    known = _WORDS.setdefault(path, {})
    fresh = [w for w in words if w not in known]
    ids, n = encode(fresh) if fresh else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
    raw, stop = ids.tobytes(), np.cumsum(n) * 4
    new = {w: raw[a:b] for w, a, b in zip(fresh, [0, *stop.tolist()], stop.tolist(), strict=False)}
    if len(known) + len(new) > CACHED_WORDS:
        often = {w: known[w] for w in words if w in known}
        known.clear()
        known.update(often)
    table = known if len(known) + len(new) <= CACHED_WORDS else dict(known)
    table.update(new)
    parts = [table[w] for w in words]
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4


def _whole(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of any words, one after another, and how many each has."""
    tok, _, mark = _tokenizer(path)
    if mark and not any(mark[0][:2] in w for w in words):

        def cut(ids):
            at = np.flatnonzero(ids == mark[1])
            return ids[ids != mark[1]], np.diff(np.r_[-1, at, len(ids)]) - 1

        return _parts(tok, words, mark[0], 2000, cut)
    ids = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    return np.array([i for x in ids for i in x], dtype="<u4"), np.array([len(x) for x in ids], dtype=np.int64)


def encode_array(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (then ``end_id`` after each), and where each text's start and end.

    For tokenizers that drop white space: no token crosses it, so a text's ids are those of its words
    in turn. Words are split and numbered by Arrow, and each distinct one is encoded once: of plain
    words the letters, without regard to case, apart from the punctuation after them. Ids are then
    gathered by number.
    """
    tok, ends, _ = _tokenizer(path)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    cut = lists.offsets.to_numpy()
    cut = cut - cut[0]
    words = coded.dictionary
    plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+[{_STOPS}]*$") if ends is not None else pa.array(np.zeros(len(words), bool))
    simple = words.filter(plain)
    letters = pc.utf8_lower(pc.utf8_rtrim(simple, _STOPS)).dictionary_encode()
    tails = pc.replace_substring_regex(simple, f"^[{_LETTERS}]+", "").dictionary_encode()

    def cut_words(ids):
        at = np.flatnonzero(ends[ids]) + 1
        return ids, np.diff(np.r_[0, at])

    tables = [
        _known_words(path, letters.dictionary.to_pylist(), lambda fresh: _parts(tok, fresh, " ", 4000, cut_words)),
        _whole(path, tails.dictionary.to_pylist()),
        _whole(path, words.filter(pc.invert(plain)).to_pylist()),
        (np.array([] if end_id is None else [end_id], dtype="<u4"), np.array([0 if end_id is None else 1], dtype=np.int64)),
    ]
    size = np.concatenate([n for _, n in tables])
    flat = np.concatenate([ids for ids, _ in tables])
    begin = np.cumsum([0, *(len(n) for _, n in tables)])
    first = np.cumsum(size) - size
    # a word is its letters and its tail; other words, and the end of a text, have an empty second unit
    units = np.zeros((len(words), 2), dtype=np.int64)
    is_plain = plain.to_numpy(zero_copy_only=False)
    size, first = np.r_[size, 0], np.r_[first, 0]
    units[:, 1] = len(size) - 1
    units[is_plain, 0] = letters.indices.to_numpy()
    units[is_plain, 1] = begin[1] + tails.indices.to_numpy()
    units[~is_plain, 0] = begin[2] + np.arange(int((~is_plain).sum()))
    seq = units[number]
    if end_id is not None:
        seq = np.insert(seq, cut[1:], [begin[3], len(size) - 1], axis=0)
        cut = cut + np.arange(len(cut))
    seq = seq.reshape(-1)
    n = size[seq]
    stop = np.cumsum(n)
    ids = flat[np.repeat(first[seq] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
    return ids, np.r_[0, stop][2 * cut]


def encode_texts(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    ids, cut = encode_array(pa.array(texts, pa.binary()).cast(pa.string()), path)
    for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        yield ids[lo:hi].tobytes()


def tokenise(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, keep_ids: bool) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document, null text as empty."""
    kind = C.sql_type(docs, "doc_id")

    def run(batches):
        for b in C.slices(batches, size=5_000_000):
            tokens, cut = encode_array(b.column("text"), tokenizer, end_id)
            n = np.diff(cut)
            pieces = -(-n // capacity)
            at = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[at] - start)
            lo = (cut[:-1][at] + start).tolist()
            hi = [x + y for x, y in zip(lo, length.tolist(), strict=True)]
            crc = [zlib.crc32(tokens[x:y]) for x, y in zip(lo, hi, strict=True)]
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            ids = [pa.array([tokens[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(cols + ids, names + ["ids"] * keep_ids)

    return C.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def price(lengths: np.ndarray, profit: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the best profit within each room 0..capacity.

    Lengths that a shorter one with as much profit dominates are never in a best configuration.
    """
    best = np.maximum.accumulate(profit)
    front = np.r_[True, profit[1:] > best[:-1]]
    ls, ps = lengths[front], profit[front]
    value = np.zeros(capacity + 1)
    fits = np.searchsorted(ls, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        value[c] = max(value[c - 1], (ps[:k] + value[c - ls[:k]]).max()) if k else value[c - 1]
    return value


def fractional(hist: dict[int, int], capacity: int, rounds: int, passes: int, slack: float, rate: float, enough: float) -> dict[tuple[int, ...], float]:
    """The covering program's solution by multiplicative weights: configuration -> times.

    A pass prices configurations under the weights of what is still uncovered of each length, then
    takes configurations within ``slack`` of the best price, length by length, until each length has
    got its share (1 / ``rounds`` of its pieces) or no such configuration is left of lengths that
    have not. Then it prices again; it ends when all but ``enough`` of the tokens are covered.
    """
    lengths = np.array(sorted(hist), dtype=np.int64)
    demand = np.array([hist[x] for x in lengths.tolist()], dtype=np.float64)
    left, times = demand.copy(), defaultdict(float)
    for _ in range(passes):
        live = np.flatnonzero(left > 1e-9)
        if not len(live) or (lengths * left).sum() <= enough * (lengths * demand).sum():
            break
        ls, uncovered = lengths[live], left[live] / demand[live]
        profit = ls * np.exp(rate * (uncovered - uncovered.max()))
        value = price(ls, profit, capacity)
        least = (1 - slack) * value[capacity]
        room = np.minimum(left[live], np.ceil(demand[live] / rounds))
        for i in np.argsort(-profit, kind="stable").tolist():
            while room[i] > 1e-9:
                use, c, got = {i: 1}, capacity - int(ls[i]), profit[i]
                while c >= ls[0]:
                    k = int(np.searchsorted(ls, c, side="right"))
                    total = np.where(room[:k] > 1e-9, profit[:k] + value[c - ls[:k]], -1.0)
                    top = total.max()
                    if top <= 0 or got + top < least:
                        break
                    # of the lengths that are as good, that of which most is left
                    near = np.flatnonzero(total >= top * (1 - slack / 4))
                    j = int(near[room[near].argmax()])
                    use[j], c, got = use.get(j, 0) + 1, c - int(ls[j]), got + profit[j]
                if got < least:
                    break
                step = min(room[j] / a for j, a in use.items())
                step = float(int(step)) if step >= 1 else step
                times[tuple(sorted((int(ls[j]) for j, a in use.items() for _ in range(a)), reverse=True))] += step
                for j, a in use.items():
                    room[j] = max(0.0, room[j] - a * step)
                    left[live[j]] = max(0.0, left[live[j]] - a * step)
    return times


def rounded(left: dict[int, int], times: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole numbers of sequences, each its times rounded up as far as pieces are ``left``, which are taken."""
    out = []
    for config, x in sorted(times.items(), key=lambda p: (-p[1], p[0])):
        need: dict[int, int] = defaultdict(int)
        for v in config:
            need[v] += 1
        n = min([int(np.ceil(x - 1e-9)), *(left[v] // a for v, a in need.items())])
        if n > 0:
            out.append((config, n))
            for v, a in need.items():
                left[v] -= n * a
    return out


def plan(hist: dict[int, int], capacity: int, rounds: int = 2, passes: int = 24, slack: float = 0.02, rate: float = 0.05, enough: float = 0.01, fill: float = 0.03) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole numbers of sequences that hold exactly the pieces of ``hist``.

    The rounded solution of the program over all but the shortest pieces, with ``fill`` of the tokens;
    these, and the pieces that it leaves, go best-fit into the room of its sequences, longest first,
    and into sequences of their own.
    """
    left = {x: n for x, n in hist.items() if n > 0}
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    if capacity in left:
        open_[0][(capacity,)] = left.pop(capacity)
    lengths = sorted(left)
    tokens = np.cumsum([x * left[x] for x in lengths])
    main = {x: left[x] for x in lengths[int(np.searchsorted(tokens, fill * tokens[-1])) :]} if lengths else {}
    for config, n in rounded(left, fractional(main, capacity, rounds, passes, slack, rate, enough)) if main else ():
        open_[capacity - sum(config)][config] += n
    have = np.zeros(capacity + 1, dtype=bool)
    for room in open_:
        have[room] = room > 0

    def put(config, n, room):
        open_[room][config] += n
        have[room] = room > 0

    for v in sorted(left, reverse=True):
        n = left[v]
        while n > 0:
            found = have[v:]
            k = int(found.argmax()) if len(found) else 0
            if not len(found) or not found[k]:
                per = capacity // v
                if n >= per:
                    put((v,) * per, n // per, capacity - per * v)
                if n % per:
                    put((v,) * (n % per), 1, capacity - (n % per) * v)
                n = 0
                break
            room = v + k
            config, count = open_[room].popitem()
            per = room // v
            full = min(count, n // per)
            if full:
                put(config + (v,) * per, full, room - per * v)
                n -= full * per
            rest = count - full
            if rest and n:  # fewer than per are left
                put(config + (v,) * n, 1, room - n * v)
                rest, n = rest - 1, 0
            if rest:
                open_[room][config] += rest
            have[room] = bool(open_[room])
    return [(config, n) for room in open_ for config, n in open_[room].items() if n]


def places(configs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each (length, configuration): key (length and first rank), first sequence, pieces a sequence, offset."""
    rows, ranks, base = [], defaultdict(int), 0
    for config, n in configs:
        offset = 0
        use: dict[int, int] = {}
        for v in config:
            use[v] = use.get(v, 0) + 1
        for v, a in use.items():
            rows.append((v, ranks[v], base, a, offset))
            ranks[v] += n * a
            offset += v * a
        base += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return (a[:, 0] << 44) | a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4]


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, keep_ids: bool = False, rounds: int = 2, group: int = 128) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.
    Null and empty texts give one piece with the end id alone; a document is cut only where it is
    longer than ``capacity``, however long; rows that repeat are packed each; a null doc_id stays
    null; pieces of one length take places in the order in which they were read; an empty table gives no rows. Other columns of ``docs`` are ignored, whatever
    their names.
    """
    C.need(docs, "doc_id", "text")
    spark = docs.sparkSession
    # numbered and written: the numbers stay, and deal pieces that are alike
    pieces = C.materialise(tokenise(docs, capacity, tokenizer or default_tokenizer(), end_id, keep_ids).withColumn("n", F.monotonically_increasing_id()), "pieces")
    counts = pieces.groupBy("length").count()
    hist = {r["length"]: r["count"] for r in counts.collect()}  # at most ``capacity`` rows
    key, first, seq, each, off = places(plan(hist, capacity, rounds))
    # ranks within a length: dealt by (length, salt), so that no length needs a task of its own
    salts = spark.createDataFrame([(n, max(1, min(4096, -(-c // group)))) for n, c in hist.items()], "length bigint, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("n"), F.col("salts").cast("bigint"))).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("n")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*names, (F.col("before") + F.col("rank") - 1).alias("rank"))
    kind = C.sql_type(docs, "doc_id")

    def locate(batches):
        for b in batches:
            length, rank = (b.column(x).to_numpy() for x in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            at = rank - first[i]
            out = [pa.array(seq[i] + at // each[i], pa.int64()), pa.array(off[i] + at % each[i] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *out], [*names, "sequence_id", "offset"])

    return C.map_batches(ranked, locate, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids + ", sequence_id bigint, offset bigint")
