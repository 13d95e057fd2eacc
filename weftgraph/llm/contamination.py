"""Operator 8, benchmark decontamination [native]: containment search with size-partitioned MinHash.

Items are partitioned by size (powers of two of their shingles). A partition's sketch is the k
smallest hashes of an item's shingles, k one more than a match may lack of the partition's largest
item: a document that contains the item to the threshold holds at least one of them, so the search
loses nothing. Long documents probe the sketches in one map-side pass, against a bitmap of a bounded
size: those with a hit are written with their hits and with those of their shingles that may belong
to items at all. Hits are joined with the sketches, and each pair of a document and an item is
verified once, by exact containment of the shingles' words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a probe's bitmap: at most so many as a power of two (2 MB), of which a hash sets three.
BITMAP_BITS = 24


def _shingled(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds w (lower-cased runs of letters and digits) and h (a hash of each shingle, by size and place)."""
    df = df.withColumn("w", F.expr(r"filter(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), x -> x <> '')"))
    hashes = []
    for n in sizes:
        args = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
        hashes.append(f"IF(size(w) < {n}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size(w) - {n}), i -> xxhash64({args})))")
    return df.withColumn("h", F.expr(hashes[0] if len(sizes) == 1 else f"concat({', '.join(hashes)})"))


def _texts(n: int, places: Callable[[Column], Column] = lambda i: F.lit(True)) -> Column:
    """The distinct shingles of ``n`` words of w as texts; only those at ``places``."""
    at = F.filter(F.sequence(F.lit(0), F.size("w") - n), places)
    texts = F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    return F.when(F.size("w") < n, F.array().cast("array<string>")).otherwise(F.array_distinct(texts))


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """(item_id, size, h, shingles, n): a row for each distinct item with a word, with its distinct shingles.

    An item of fewer than ``words`` words has its whole sequence for its only shingle.
    """
    t = items.select("item_id", "text").distinct()
    out = None
    for n in range(1, words + 1):
        one = _shingled(t, [n]).withColumn("size", F.lit(n)).where((F.size("w") >= n) if n == words else (F.size("w") == n))
        one = one.select("item_id", "size", F.array_distinct("h").alias("h"), _texts(n).alias("shingles"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("n", F.size("shingles"))


def item_sketches(shingled: DataFrame, percent: int) -> DataFrame:
    """(key, item): a row for each hash in the sketch of an item."""
    t = shingled.withColumn("top", F.expr("shiftleft(2, CAST(floor(log2(n)) AS INT)) - 1"))  # the largest size in the partition
    t = t.withColumn("k", F.expr(f"CAST(floor(top * {100 - percent} / 100) AS INT) + 1"))
    return t.select(F.explode(F.expr("slice(sort_array(h), 1, k)")).alias("key"), "item").distinct()


class Bitmap:
    """A Bloom filter of hashes (column x) in 2 ** ``bits`` bits, each hash setting three; a literal in expressions."""

    def __init__(self, hashes: DataFrame, bits: int | None):
        self.bits = bits or min(BITMAP_BITS, max(16, (256 * hashes.count()).bit_length()))
        places = hashes.select(F.explode(F.array(*self._places(F.col("x")))).alias("place"))
        words = places.select(F.shiftright("place", 6).alias("at"), (F.col("place") % 64).cast("int").alias("bit"))
        words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
        held = {r["at"]: r["word"] for r in words.collect()}  # at most 2 ** (bits - 6) rows
        text = ",".join(str(held.get(k, 0)) for k in range(1 << self.bits - 6))
        self.words = F.split(F.lit(text), ",").cast("array<bigint>")  # folded into a literal

    def _places(self, x: Column) -> list[Column]:
        return [F.shiftrightunsigned(y, 64 - self.bits) for y in (x, F.shiftleft(x, self.bits), F.xxhash64(x))]

    def may_hold(self, x: Column) -> Column:
        first, *more = [F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in self._places(x)]
        for test in more:  # evaluated only where those before hold
            first = first & test
        return first


def _held(of: Bitmap, before: Column) -> Callable[[Column], Column]:
    return lambda i: of.may_hold(F.get("h", i + before))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, bitmap_bits: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment) of items held by a document to ``percent``.

    Shingles are ``words`` consecutive words, lower-cased runs of letters and digits, as a set; an item
    with fewer words has its whole sequence for its only shingle, and is found where a document holds
    these words in a row. Items and documents without words match nothing, as do null and empty texts.
    Documents are read whole. Rows that repeat a doc_id or item_id give one row, with the most found; a
    null doc_id or item_id stands as it is. Columns beyond doc_id, item_id and text are ignored,
    whatever their names; either table empty gives no rows. ``bitmap_bits``: the size of the probe's
    bitmaps, else 16 to BITMAP_BITS by the number of hashes; what passes them by chance costs time,
    but changes nothing.
    """
    C.need(docs, "doc_id", "text")
    C.need(items, "item_id", "text")
    shingled = C.materialise(item_shingles(items, words).withColumn("item", F.monotonically_increasing_id()), "items")
    keys = C.materialise(item_sketches(shingled, percent), "sketches")
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect()) or [words]  # at most ``words``
    in_sketch, in_item = Bitmap(keys.select(F.col("key").alias("x")), bitmap_bits), Bitmap(shingled.select(F.explode("h").alias("x")), bitmap_bits)
    hits = _shingled(docs.select("doc_id", "text"), sizes).select("doc_id", "text", F.array_distinct(F.filter("h", in_sketch.may_hold)).alias("hits"))
    # explode_outer: a filter on the array would be pushed below it and evaluate it twice
    some = hits.select("doc_id", "text", F.explode_outer(F.expr("IF(size(hits) > 0, array(hits), NULL)")).alias("hits")).where("hits IS NOT NULL")
    probed = C.materialise(some.withColumn("row", F.monotonically_increasing_id()), "probed")
    # written, so that the numbers stay: each document's shingles that may be an item's, and its candidates
    of = _shingled(probed.select("row", "doc_id", "text"), sizes)
    mine, before = [], F.lit(0)
    for n in sizes:
        mine.append(_texts(n, _held(in_item, before)))
        before = before + F.greatest(F.size("w") - n + 1, F.lit(0))
    of = of.select("row", "doc_id", (mine[0] if len(mine) == 1 else F.concat(*mine)).alias("mine"))
    pairs = probed.select("row", F.explode("hits").alias("key")).join(keys, "key").select("row", "item").distinct()
    exact = pairs.join(of, "row").join(shingled.select("item", "item_id", "n", "shingles"), "item").select("doc_id", "item_id", "n", F.size(F.array_intersect("shingles", "mine")).alias("found"))
    best = exact.where(F.col("found") * 100 >= F.col("n") * percent).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("found") / F.col("n"), "found", "n")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n").cast("bigint").alias("n_shingles"), F.col("x.found").cast("bigint").alias("n_found"), F.round(F.col("x.found") / F.col("x.n"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id contains no item; defined as ``contained``."""
    held = contained(docs, items, words, percent).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, docs["doc_id"].eqNullSafe(held["__held"]), "left_anti")


def decontaminate_rows(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """As ``decontaminate``, but each row is judged by its own text, whatever rows share its doc_id or have none."""
    row = F.struct(F.col("doc_id").alias("id"), C.text_key().alias("key"))
    held = contained(docs.select(row.alias("doc_id"), "text"), items, words, percent)
    held = held.select(F.col("doc_id.id").alias("__held"), F.col("doc_id.key").alias("__held_key")).distinct()
    mine = docs.withColumn("__key", C.text_key())
    return mine.join(held, (mine["__key"] == held["__held_key"]) & mine["doc_id"].eqNullSafe(held["__held"]), "left_anti").select(*docs.columns)
