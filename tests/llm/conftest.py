from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    words = "the of and to in is that it for was on as with by river stone light over under wind bread glass paper".split()
    made = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ti", "so"]) for _ in range(rng.randrange(2, 5)))
    out = [rng.choice(words) if rng.random() < 0.5 else made() for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ".", ",", "\n"]) for w in out)


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared lines and passages, repeated rows."""
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(1, 220))) for i in range(60)]
    passage = prose(rng, 60)
    docs += [(100 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 20)}") for i in range(4)]
    docs += [(200 + i, docs[7][1]) for i in range(5)]  # copies
    near = docs[9][1].split(" ")
    for i in range(5):
        w = list(near)
        w[(7 * i + 3) % len(w)] = "changed"
        docs.append((210 + i, " ".join(w)))
    line = "A line that many documents share, Ärger"
    docs += [(220 + i, f"{prose(rng, 12)}\n {line.upper() if i == 1 else line}\t\n{prose(rng, 9)}\n{line}") for i in range(3)]
    docs += [(300, ""), (301, None), (302, " \t\n\x0b\x0c\r "), (303, "\n\n"), (304, "one"), (305, "two words"), (306, "a b c"), (307, "été ß Ünï 日本語   x"), (308, "!!! ??? 123 ..."), (None, prose(rng, 80)), (None, passage)]
    docs.append((310, " ".join(prose(rng, 4000).split())))  # long
    docs.append((311, "same " * 200))
    docs += [docs[3], docs[3], docs[62]]  # repeated rows
    docs.append((5, prose(rng, 50)))  # an id with another text
    langs = ["en", "de", None]
    return [(k, t, langs[i % 3], None if i % 5 == 0 else f"s{i % 4}", None if i % 7 == 0 else len(t or "")) for i, (k, t) in enumerate(docs)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    clash = "fingerprint component_id n_lines n_dropped n_words n_removed score lang_pred secrets piece start length kept fp cell key row at doc h w".split()
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
