"""What the training-data operators share: shared scratch tables, column rules, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers, shared_dir, shared_table

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share (a local one only where it is unset)."""
    return shared_dir(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and lets several consumers use one computation. The files are on shared
    storage, so that a lost executor loses nothing of it.
    """
    return shared_table(df, name)


def settled(df: DataFrame) -> DataFrame:
    """``df`` if its rows come in the same order whenever they are read (from files), else a written copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, "settled") if "Exchange" in plan or "ShuffleQueryStage" in plan else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def need(df: DataFrame, *names: str) -> None:
    have = {c.lower() for c in df.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return pc.fill_null(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()), b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2000, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has few rows and about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, x in enumerate(lengths):
            if i > start and (i - start >= rows or held + x > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += x
        yield batch.slice(start, n - start)


def give_back() -> None:
    """Return freed memory to the system: workers are kept for the next stage, beside its own."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, after which the worker holds no more than it needs."""
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[next(c for c in df.columns if c.lower() == name.lower())].dataType.simpleString()


def text_key():
    """128 bits of text, null as empty: tells rows apart that share a doc_id or have none."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column, modulus: int):
    """crc32 of a column as text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
