"""Bounded propagation and file zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .traverse import file_moves, levels

# Weights of file priorities and of zones; lower is sooner.
DEPTH_WEIGHT, OPEN_WEIGHT, RECENT_WEIGHT, TEST_WEIGHT, GENERATED_WEIGHT = 20, -100, -50, 30, 50
RECENT_SECONDS = 300
SYNC_FILES, ASYNC_FILES = 5, 50
ZONE_BASE, ZONE_OPEN, ZONE_RECENT, ZONE_TEST, ZONE_SECONDS = 100, -50, -30, 20, 60
HOT_FILES = 10


def file_priority(depth: Column, is_open: Column, age_seconds: Column, path: Column) -> Column:
    p = DEPTH_WEIGHT * depth + F.when(is_open, OPEN_WEIGHT).otherwise(0) + F.when(age_seconds < RECENT_SECONDS, RECENT_WEIGHT).otherwise(0)
    p = p + F.when(N.mentions_test(path), TEST_WEIGHT).otherwise(0)
    return p + F.when(F.lower(path).contains("generated") | F.lower(path).contains("build"), GENERATED_WEIGHT).otherwise(0)


def affected(file_edges: DataFrame, path: str, max_depth: int = 3) -> DataFrame:
    """(file_path, depth): files that edges of any type lead back from, the file itself left out."""
    start = file_edges.sparkSession.createDataFrame([(path,)], "id string")
    return levels(file_moves(file_edges, None, "in"), start, max_depth).select(F.col("id").alias("file_path"), "depth")


def phases(files: DataFrame) -> DataFrame:
    """Adds place and phase to (file_path, depth, priority): the first files now, some later, the rest deferred.

    The first ``SYNC_FILES`` + ``ASYNC_FILES`` are found by a bounded sort, so that no task ranks all files.
    """
    w = Window.orderBy("priority", "depth", "file_path")  # over the bounded head only
    head = files.orderBy("priority", "depth", "file_path").limit(SYNC_FILES + ASYNC_FILES)
    head = head.withColumn("place", F.row_number().over(w))
    head = head.withColumn("phase", F.when(F.col("place") <= SYNC_FILES, "sync").otherwise("async"))
    rest = files.join(head.select("file_path"), "file_path", "left_anti").withColumn("place", F.lit(None).cast("int")).withColumn("phase", F.lit("deferred"))
    return head.unionByName(rest)


def zones(accesses: DataFrame, hot: int = HOT_FILES) -> DataFrame:
    """(file, zone) from accesses (file, version, action open, close or access): by each file's last action.

    Open files are HOT, the ``hot`` last opened; what falls out of them, and what was closed or only
    accessed, is WARM.
    """
    last = accesses.groupBy("file").agg(F.max_by("action", "version").alias("action"), F.max("version").alias("version"))
    newest = last.where("action = 'open'").orderBy(F.desc("version"), "file").limit(hot).select("file", F.lit("HOT").alias("zone"))
    return last.select("file").join(newest, "file", "left").withColumn("zone", F.coalesce("zone", F.lit("WARM")))


def zone_of(files: DataFrame, zoned: DataFrame) -> DataFrame:
    """The zone of each of ``files`` (file); COLD if it has none."""
    return files.join(zoned, "file", "left").withColumn("zone", F.coalesce("zone", F.lit("COLD")))


def zone_priority(is_open: Column, age_seconds: Column, path: Column) -> Column:
    return ZONE_BASE + F.when(is_open, ZONE_OPEN).otherwise(0) + F.when(age_seconds < ZONE_SECONDS, ZONE_RECENT).otherwise(0) + F.when(N.mentions_test(path), ZONE_TEST).otherwise(0)
