"""Projects as tables: source files of a tree, and what changed since they were last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no source of the project.
SKIPPED = ("node_modules", "__pycache__", "venv", "env", "dist", "build", "target", "site-packages", "vendor")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, max_files: int | None = None) -> DataFrame:
    """(file_path, content, modified): the supported files below ``root``, paths relative to it.

    Hidden and build folders are left out, and files that are not UTF-8. ``max_files`` takes the first
    by path, for a bounded first look.
    """
    if extensions is None:
        from ..extract import REGISTRY

        extensions = tuple(e for known, _ in REGISTRY.values() for e in known)
    names = "*{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit("^"), base, F.lit("/")), F.lit(""))
    parts = F.split("file_path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED))
    t = raw.select(path.alias("file_path"), "content", F.col("modificationTime").alias("modified")).where(~hidden)
    t = t.where(F.is_valid_utf8(F.col("content").cast("string"))).select("file_path", F.col("content").cast("string").alias("content"), "modified")
    return t if max_files is None else t.orderBy("file_path").limit(max_files)


def changes_since(known: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, old_content, new_content) of files that are new, different or gone (new_content empty)."""
    k = known.select("file_path", F.col("content").alias("old_content"))
    n = now.select("file_path", F.col("content").alias("new_content"))
    j = k.join(n, "file_path", "full_outer")
    return j.where(~F.col("old_content").eqNullSafe(F.col("new_content"))).select("file_path", F.coalesce("old_content", F.lit("")).alias("old_content"), F.coalesce("new_content", F.lit("")).alias("new_content"))


def deleted_files(tracked: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracked files (file_path) that are no longer listed."""
    return tracked.select("file_path").join(listing.select("file_path"), "file_path", "left_anti")
