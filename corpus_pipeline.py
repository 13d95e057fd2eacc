"""A training-data pipeline over ``documents``, of the operators in ``weftgraph.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import common as C
from weftgraph.llm import contamination, langid, lines, packing, simhash

#: A document goes if the classifier finds no letter in it, or is less sure of its language than this.
MIN_LANGUAGE_SCORE = 0.5


def _aside(docs: DataFrame, *taken: str) -> DataFrame:
    """``docs`` with its columns of names that an operator adds under other names, for ``_back``."""
    return docs.select(*[docs[f"`{c}`"].alias(f"__own_{c}" if c.lower() in taken else c) for c in docs.columns])


def _back(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs``, with their own values but for those changed."""
    own = lambda c: df[f"`__own_{c}`" if f"__own_{c}" in df.columns else f"`{c}`"]
    return df.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with MIN_LANGUAGE_SCORE or more.

    Texts that are null or have no letter go. Rows are judged one by one, so that repeated rows and
    null ids share one fate; without any labelled row there is no language to tell, and all stay that
    have a letter.
    """
    C.on_workers(spark)
    model = langid.fit(docs, train=F.lit(True))
    told = langid.identify(_aside(docs, "lang_pred", "score"), model)
    kept = F.col("text").rlike(r"\p{L}") if not model.languages else (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _back(told.where(kept), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. A document that loses all of its text goes."""
    C.on_workers(spark)
    out = lines.drop_repeated_lines(_aside(docs, "n_lines", "n_dropped"))
    gone = (F.col("n_dropped") > 0) & (F.trim(F.translate("text", C.SPACE, " ")) == "")
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _back(out.where(~gone), docs, **changed)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the row with the smallest doc_id (nulls last; ties: by the text's hash).

    Rows are told apart by doc_id and text: those that share a doc_id, or have none, stay each unless
    they are near-duplicates. Of rows that repeat both one stays.
    """
    C.on_workers(spark)
    row = F.struct(F.isnull("doc_id").alias("absent"), F.col("doc_id").alias("id"), C.text_key().alias("key"))
    keys = simhash.near_duplicates(docs.select(row.alias("doc_id"), "text"))
    keep = keys.select(F.col("component_id.id").alias("__keep"), F.col("component_id.key").alias("__keep_key")).distinct()
    mine = docs.withColumn("__key", C.text_key())
    chosen = mine.join(keep, (mine["__key"] == keep["__keep_key"]) & mine["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds an item of ``benchmark``."""
    C.on_workers(spark)
    return contamination.decontaminate_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; returns the pieces, with their ids."""
    C.on_workers(spark)
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier's and the tokenizer's stages cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{C.scratch_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
