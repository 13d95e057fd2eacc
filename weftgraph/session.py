"""Session settings and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on one machine; on a cluster the submitter's settings hold."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("weftgraph")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    return b.config(map=settings).getOrCreate()


#: Bytes of a batch that a worker gets at once (one row at least); a session may set another size.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"
#: What keeps workers small: freed memory goes back to the system, and threads share one heap.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072"}


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this repository, wherever the driver was started, and keep them small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    if str(spark.conf.get(BATCH_KEY)) in (str(BATCH_DEFAULT), f"{BATCH_DEFAULT}b", "64m", "64MB"):
        spark.conf.set(BATCH_KEY, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where there is none, on one machine.

    What is written there is not removed: tables may be read for as long as a result is. Each
    application has a folder of its own below it, which can go when the application has ended.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("weftgraph.scratch", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("weftgraph.scratch", at)
    return at.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
