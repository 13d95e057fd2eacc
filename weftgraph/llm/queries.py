"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import contamination, langid, licenses, lines, packing, quality, rules, secrets, simhash, substrings


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    C.on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir, "doc_id", "text"), capacity=4096)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_documents(spark, sf_dir, "doc_id", "text", "lang"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), words=3, max_bits=3)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_documents(spark, sf_dir, "doc_id", "text"), min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    held = C.crc_bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, train=F.coalesce(~held, F.lit(True)))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeated_passages(_documents(spark, sf_dir, "doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contained(_documents(spark, sf_dir, "doc_id", "text"), items)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = C.crc_bucket(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, labels, "quality", train_on=~held)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _joined(spans, of):
    return F.array_join(F.transform(spans, of), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_documents(spark, sf_dir, "doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base, text), 256).alias("base_sha256"), _joined(F.col("secrets"), text).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_simhash, op4_line_dedup, op5_language_id, op6_license_scan, op7_substring_dedup, op8_decontamination, op9_quality_classifier, op10_secret_scan)}


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

#: DuckDB's form of the queries that SQL can express, over the whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, h.keeper IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE s IN (SELECT s FROM rep)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM w),
y AS (SELECT x.doc_id, count(cov.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (cov.p IS NULL) AS kept FROM x LEFT JOIN cov ON x.doc_id = cov.doc_id AND x.p = cov.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y USING (doc_id)
""",
    "op8_decontamination": f"""
WITH i AS (SELECT item_id, w, least(len(w), 5) AS size FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0), d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + size - 1], ' ') AS s FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM i)),
sd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id), f AS (SELECT doc_id, item_id, count(*) AS n_found FROM sd JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_shingles * 80
""",
}
