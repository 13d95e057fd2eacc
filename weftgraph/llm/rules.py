"""Operator 2, quality rules [native]: divergence of a text's distributions from its language's.

Two histograms of each text, of character classes and of common words, are compared with those of
every language of the corpus by Jensen-Shannon distance; the nearest language decides. What small
samples add to the distance is allowed for, and texts under the minimum length are not judged by it
but fail. Everything is DataFrame functions: the words are counted by language, then each text
becomes a row of counts; these are written, the references are sums of them, and the verdict is an
expression over them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Character classes by regular expression; white space and the rest are counted by difference.
CLASSES = {"upper": "A-Z", "digit": "0-9", "stop": ".,;:", "mark": "!?", "symbol": "#*$%&|<>"}
CELLS = [*CLASSES, "space", "other"]


def _lang(docs: DataFrame):
    have = any(c.lower() == "lang" for c in docs.columns)
    return (docs["lang"].cast("string") if have else F.lit(None).cast("string")).alias("lang")


_SPACES = C.SPACE_CLASS.replace("\\", "\\\\")  # once more, for an SQL literal
_TOKENS = f"split(lower(t), '[{_SPACES}.,;:!?]+')"  # empty at the ends at most


def common_words(docs: DataFrame, n_common: int) -> dict[str, dict[str, int]]:
    """The ``n_common`` most frequent words of each lang with their counts, ties by word.

    Words of any length that are all letters; counted by partition before they are shuffled.
    """
    t = docs.select(_lang(docs), F.coalesce("text", F.lit("")).alias("t")).where("lang IS NOT NULL")
    words = t.select("lang", F.explode(F.expr(_TOKENS)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).where(r"w rlike '^\\p{L}+$'")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    out: dict[str, dict[str, int]] = {}
    for r in words.withColumn("k", F.row_number().over(first)).where(F.col("k") <= n_common).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], {})[r["w"]] = r["n"]
    return out


def _repeated(x: str, of: str) -> str:
    """Whether the sorted array ``of`` has ``x`` (its element i) for a neighbour, by SQL over x, y."""
    same = lambda y: x.replace("$", y)
    return f"CASE WHEN i > 0 AND {same(f'get({of}, i - 1)')} THEN true WHEN i < size({of}) - 1 THEN {same(f'get({of}, i + 1)')} ELSE false END"


def counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row of counts for each row of ``docs`` (doc_id, text, lang): the base rules' and the histograms'.

    words has the distinct words of ``vocabulary`` in the text, with their counts.
    """
    t = docs.select("doc_id", _lang(docs), F.coalesce("text", F.lit("")).alias("t"))
    known = f"sort_array(filter(tokens, x -> x IN ({', '.join(map(_literal, vocabulary))})))" if vocabulary else "CAST(array() AS ARRAY<STRING>)"
    t = t.selectExpr(
        "doc_id",
        "lang",
        "t",
        f"filter(split(t, '[{_SPACES}]+'), w -> w <> '') AS w",
        f"filter(split(t, '\\n'), x -> length(btrim(x, '{C.SPACE}')) > 0) AS lines",
        f"{_TOKENS} AS tokens",
        # what most of a text is belongs to no class and goes in one pass
        f"regexp_replace(t, '[a-z{_SPACES}]+', '') AS rare",
    )
    t = t.selectExpr(
        "doc_id",
        "lang",
        "w",
        f"{known} AS known",
        "size(w) AS n_words",
        "length(array_join(w, '')) AS word_chars",
        "length(t) AS n_chars",
        *[f"length(regexp_replace(rare, '[^{x}]+', '')) AS c_{k}" for k, x in CLASSES.items()],
        "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
        "shiftleft(CAST(1 AS BIGINT), length(bin(size(w)))) - 1 AS mask",
        "size(tokens) - CAST(get(tokens, 0) = '' AS INT) - CAST(size(tokens) > 1 AND element_at(tokens, -1) = '' AS INT) AS n_tokens",
    )
    # places of 3-word windows by the high bits of their hash: those alike may be equal, all others are not
    t = t.withColumn("at", F.expr("IF(n_words < 3, CAST(array() AS ARRAY<BIGINT>), sort_array(transform(sequence(0, n_words - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~mask) | i)))"))
    t = t.withColumn("alike", F.expr(f"transform(filter(at, (x, i) -> {_repeated('((x ^ $) & ~mask) = 0', 'at')}), x -> CAST(x & mask AS INT))"))
    # their words decide
    t = t.withColumn("exact", F.expr("sort_array(transform(alike, p -> struct(w[p] AS a, w[p + 1] AS b, w[p + 2] AS c, p AS p)))"))
    equal = "(x.a = $.a AND x.b = $.b AND x.c = $.c)"
    t = t.withColumn("twice", F.expr(f"sort_array(transform(filter(exact, (x, i) -> {_repeated(equal, 'exact')}), x -> x.p))"))
    t = t.withColumn("bounds", F.expr("IF(size(known) = 0, CAST(array() AS ARRAY<INT>), filter(sequence(0, size(known) - 1), i -> CASE WHEN i = 0 THEN true ELSE known[i] <> known[i - 1] END))"))
    return t.selectExpr(
        "doc_id",
        "lang",
        "CAST(n_words AS BIGINT) AS n_words",
        "CAST(word_chars AS BIGINT) AS word_chars",
        "CAST(n_dup_lines AS BIGINT) AS n_dup_lines",
        # a window covers three words, less those that the next one covers
        "aggregate(transform(twice, (x, i) -> CASE WHEN i = size(twice) - 1 THEN CAST(3 AS BIGINT) ELSE CAST(least(3, get(twice, i + 1) - x) AS BIGINT) END), CAST(0 AS BIGINT), (a, x) -> a + x) AS n_repeat_words",
        *[f"CAST(c_{k} AS BIGINT) AS c_{k}" for k in CLASSES],
        "CAST(n_chars - word_chars AS BIGINT) AS c_space",
        f"CAST(word_chars - {' - '.join(f'c_{k}' for k in CLASSES)} AS BIGINT) AS c_other",
        "CAST(n_tokens AS BIGINT) AS n_tokens",
        "transform(bounds, (i, k) -> struct(known[i] AS w, CASE WHEN k = size(bounds) - 1 THEN size(known) ELSE get(bounds, k + 1) END - i AS n)) AS words",
    )


@dataclass
class Reference:
    lang: str
    classes: list[float]  #: the shares of CELLS
    words: dict[str, float]  #: the shares of its common words


def references(counted: DataFrame, common: dict[str, dict[str, int]]) -> list[Reference]:
    """A reference for each lang with words, the largest first."""
    known = counted.where("lang IS NOT NULL")
    out = []
    for r in known.groupBy("lang").agg(F.sum("n_tokens").alias("tokens"), *[F.sum(f"c_{k}").alias(k) for k in CELLS]).where("tokens > 0").orderBy(F.desc("tokens"), "lang").collect():
        chars = max(1, sum(r[k] for k in CELLS))
        out.append(Reference(r["lang"], [r[k] / chars for k in CELLS], {w: n / r["tokens"] for w, n in common.get(r["lang"], {}).items()}))
    return out


def _term(p: str, q: str) -> str:
    """A cell's part of the divergence of shares p (an expression) and q > 0, in bits, doubled."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0D END + {q} * log2(2 * {q} / ({p} + {q})))"


def divergences(counted: DataFrame, refs: list[Reference]) -> DataFrame:
    """Adds word_divergence and class_divergence: to the nearest reference, null without any.

    The references are literals, and the expressions over them are as long for many as for one.
    """
    tiny, none = 1e-12, F.lit(None).cast("double")
    t = counted.withColumn("chars", F.expr("greatest(1, " + " + ".join(f"c_{k}" for k in CELLS) + ")"))
    number = lambda x: f"{x:.17e}D"
    shares = "array(" + ", ".join("array(" + ", ".join(number(max(q, tiny)) for q in r.classes) + ")" for r in refs) + ")"
    parts = " + ".join(_term(f"(c_{k} / chars)", f"r[{i}]") for i, k in enumerate(CELLS))
    t = t.withColumn("class_divergence", F.expr(f"IF(n_words > 0, array_min(transform({shares}, r -> 0.5D * ({parts}))), 1D)") if refs else none)
    worded = [r for r in refs if r.words]
    if not worded:
        return t.withColumn("word_divergence", none)
    of: dict[str, list[str]] = {}
    for i, r in enumerate(worded):
        for w, q in r.words.items():
            of.setdefault(w, []).append(f"struct({i} AS l, {number(q)} AS q)")
    table = "map(" + ", ".join(f"{_literal(w)}, array({', '.join(x)})" for w, x in sorted(of.items())) + ")"
    t = t.withColumn("met", F.expr(f"flatten(transform(words, x -> transform(try_element_at({table}, x.w), y -> struct(y.l AS l, CAST(x.n AS DOUBLE) / n_tokens AS p, y.q AS q))))"))
    totals = "array(" + ", ".join(f"struct({number(sum(r.words.values()))} AS q, {number(max(1 - sum(r.words.values()), tiny))} AS rest)" for r in worded) + ")"
    fold = f"aggregate(filter(met, x -> x.l = l), struct(r.q AS d, 0D AS p), (a, x) -> struct(a.d + {_term('x.p', 'x.q')} - x.q AS d, a.p + x.p AS p), a -> 0.5D * (a.d + {_term('greatest(0D, 1D - a.p)', 'r.rest')}))"
    nothing = number(min(0.5 * (s + math.log2(2 / (1 + (q := max(1 - s, tiny)))) + q * math.log2(2 * q / (1 + q))) for s in (sum(r.words.values()) for r in worded)))
    return t.withColumn("word_divergence", F.expr(f"CASE WHEN n_tokens = 0 THEN 1D WHEN size(met) = 0 THEN {nothing} ELSE array_min(transform({totals}, (r, l) -> {fold})) END"))


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, word_limit: float = 0.05, class_limit: float = 0.08, n_common: int = 32) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text[, lang]) with its counts, divergences and verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_divergence,
    class_divergence, kept. Common words are the ``n_common`` most frequent of each lang, lower-cased
    and of any length (ties: by word); every lang of the table is a reference. A text passes if its
    class divergence is at most ``class_limit`` and its word divergence at most ``word_limit`` and 1.25
    times what sampling adds to it, (cells - 1) / (8 ln 2 words). Null and empty texts have no words and
    fail; texts are read whole, and repeated windows told by their words; rows with a null lang are
    judged, but add to no reference; without any reference only the base rules judge; repeated rows
    each come back; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    C.need(docs, "doc_id", "text")
    common = common_words(docs, n_common)
    counted = C.materialise(counts(docs, sorted({w for x in common.values() for w in x})), "counts")
    t = divergences(counted, references(counted, common))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    noise = 1.25 * n_common / (8 * math.log(2))
    fits = (F.coalesce("word_divergence", F.lit(0.0)) <= word_limit + F.lit(noise) / F.greatest("n_tokens", F.lit(1))) & (F.coalesce("class_divergence", F.lit(0.0)) <= class_limit)
    return t.select("doc_id", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), "word_divergence", "class_divergence")
