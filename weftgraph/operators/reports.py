"""Scores and costs of assistant runs, and the plain rebuild that the engine is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_and_spread(runs: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """Mean and population deviation of ``value``; 0 for a single run."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_pop(value), digits).alias("std"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 3.0, price_out: float = 15.0) -> Column:
    """Cost of a run, prices by a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def references(text: Column, pattern: str) -> Column:
    """How many distinct matches of a pattern a text holds."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def camel_words(text: Column) -> Column:
    """The capitalised words of a text or name."""
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0))


def naive_calls(nodes: DataFrame, references_: DataFrame) -> DataFrame:
    """(source_id, target_id): each called name to the first function of that name, as a full rebuild would."""
    first = nodes.where("type = 'function'").groupBy("name").agg(F.min_by("id", F.struct("file_path", "line_start", "id")).alias("target_id"))
    return references_.join(first, "name").select("source_id", "target_id").distinct()


def naive_affected(files: DataFrame, changed: str) -> DataFrame:
    """Files whose content holds the base name of the changed one."""
    base = changed.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return files.where(F.col("content").contains(base) & (F.col("file_path") != changed)).select("file_path")


# Ends of names that are taken for paths; how far before and after its first word a camel-case name may be spread.
PATH_ENDS = (".py", ".ts", ".js", ".rs")
NEAR_BEFORE, NEAR_AFTER = 20, 100


def mentioned(mention: Column, response: Column) -> Column:
    """Whether a response names something, at the borders of words or paths and without regard to case.

    A mention that ends in ``_`` must start a word; one with a slash or a path's end must follow a
    space, a quote or a slash; others must stand as a word, or, in camel case, have all their words
    near an occurrence of the first. Null on either side: false.
    """
    m, r = F.lower(mention), F.lower(response)
    literal = F.concat(F.lit("\\Q"), m, F.lit("\\E"))
    path = m.contains("/")
    for end in PATH_ENDS:
        path = path | F.endswith(m, F.lit(end))
    words = F.transform(camel_words(mention), lambda w: F.lower(w))
    first = F.element_at(words, 1)
    lone = F.coalesce(F.length(r), F.lit(0)) - F.length(first) + 1

    def near(at: Column) -> Column:
        start = F.greatest(at - NEAR_BEFORE, F.lit(1))
        window = F.substring(r, start, at + NEAR_AFTER - start)
        return (F.substring(r, at, F.length(first)) == first) & F.forall(words, lambda w: F.contains(window, w))

    camel = F.when(F.regexp_like(mention, F.lit("^([A-Z][a-z]+){2,}$")) & F.contains(r, first) & (lone >= 1), F.exists(F.sequence(F.lit(1), lone), near)).otherwise(False)
    plain = F.regexp_like(r, F.concat(F.lit("(^|[^a-z0-9_])"), literal, F.lit("([^a-z0-9_]|$)")))
    found = F.when(F.endswith(m, F.lit("_")), F.regexp_like(r, F.concat(F.lit("(^|[\\s,;:({/])"), literal))).when(path, F.regexp_like(r, F.concat(F.lit("(^|[\\s`\"'/])"), literal))).otherwise(plain | camel)
    return F.coalesce(found, F.lit(False))


def accuracy(runs: DataFrame, by: str) -> DataFrame:
    """(by, n_expected, n_found, accuracy) of ``runs`` (by, expected array, response); nothing expected: 1."""
    e = F.coalesce("expected", F.array().cast("array<string>"))
    hits = F.size(F.filter(e, lambda m: mentioned(m, F.col("response"))))
    r = runs.select(by, F.size(e).cast("bigint").alias("n_expected"), hits.cast("bigint").alias("n_found"))
    return r.withColumn("accuracy", F.when(F.col("n_expected") > 0, F.round(F.col("n_found") / F.col("n_expected"), 6)).otherwise(1.0))
