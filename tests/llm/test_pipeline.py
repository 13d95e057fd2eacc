"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from collections import Counter

import brute as B
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid


@pytest.fixture(scope="module")
def five(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def texts(df) -> Counter:
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language_stage(spark, sf, five, rows):
    kept = P.language_stage(spark, five, sf)
    assert kept.columns == five.columns
    model = langid.fit(five, F.lit(True))
    names, score = model.score([t or "" for _, t, *_ in rows])
    assert texts(kept) == Counter((k, t) for (k, t, *_), n, s in zip(rows, names, score, strict=True) if n != "und" and s >= P.MIN_LANGUAGE_SCORE)


def test_line_stage(spark, sf, five, rows):
    kept = P.line_stage(spark, five, sf)
    assert kept.columns == five.columns
    want = Counter((k, t) for k, _, gone, t in B.line_dedup([(k, t) for k, t, *_ in rows]) if not (gone and not B.WORD.search(t)))
    assert texts(kept) == want


def test_simhash_stage(spark, sf, five, rows):
    kept = P.simhash_stage(spark, five, sf)
    assert kept.columns == five.columns
    # a row is its doc_id and text: unlike rows that share an id, or have none, are kept each
    import hashlib

    keys = [(k is None, k or 0, hashlib.md5((t or "").encode()).hexdigest()) for k, t, *_ in rows]
    comp = B.clusters(keys, [B.fingerprint(t) for _, t, *_ in rows])
    got = Counter((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert got == Counter(set(comp.values()))


def test_decontamination_stage(spark, sf, five):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    more = five.unionByName(spark.createDataFrame([(5000 + i, f"before it {r.text} after it", "en", "s", 1) for i, r in enumerate(items)], five.schema))
    kept = P.decontamination_stage(spark, more, sf)
    assert kept.columns == five.columns
    assert texts(kept) == texts(five)


def test_stages_tell_rows_apart_without_ids(spark, sf, five):
    """Clean rows that share a doc_id or have none all stay; near-duplicates and contaminated rows among them go."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ti", "so"]) for _ in range(4))
    clean = [" ".join(word() for _ in range(120)) for _ in range(20)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None if i % 2 else 7, t, "en", "s", 1) for i, t in enumerate(clean)]
    kept = P.simhash_stage(spark, spark.createDataFrame([*rows, rows[1], (None, clean[0], "en", "s", 1)], five.schema), sf)
    assert texts(kept) == Counter((k, t) for k, t, *_ in rows)
    held = [(k, f"{word()} {item} {word()}", "en", "s", 1) for k in (None, 7)]
    kept = P.decontamination_stage(spark, spark.createDataFrame([*rows, *held], five.schema), sf)
    assert texts(kept) == Counter((k, t) for k, t, *_ in rows)


def test_packing_stage(spark, sf, five, rows):
    out = P.packing_stage(spark, five, sf).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(k for k, *_ in rows)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_extra_columns(spark, sf, docs, name):
    """Columns that are called as those that operators add keep their own values."""
    out = dict(P.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select("score", "n_lines", "n_dropped", "lang_pred", "component_id").distinct().collect()} == {("clash",) * 5}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_empty_tables(spark, sf, five, name):
    assert dict(P.STAGES)[name](spark, five.where("false"), sf).count() == 0


def test_run_keeps_each_clean_document_once(spark):
    """The whole pipeline on a table: what it packs is what plain versions of the stages keep."""
    from tokenizers import Tokenizer

    from weftgraph.llm import packing

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    names, score = model.score([t or "" for _, t, _ in rows])
    kept = [(k, t) for (k, t, _), n, s in zip(rows, names, score, strict=True) if n != "und" and s >= P.MIN_LANGUAGE_SCORE]
    kept = [(k, t) for k, _, gone, t in B.line_dedup(kept) if not (gone and not B.WORD.search(t))]
    comp = B.clusters([k for k, _ in kept], [B.fingerprint(t) for _, t in kept])
    stay = set(comp.values())
    kept = [(k, t) for k, t in kept if k in stay]
    held = {d for d, _ in B.contained(kept, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for k, t in kept:
        if k not in held:
            ids = B.tokens(t, tok)
            for p, lo in enumerate(range(0, len(ids), 4096)):
                want[k, p, len(ids[lo : lo + 4096]), B.crc(ids[lo : lo + 4096])] += 1
    got = P.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
