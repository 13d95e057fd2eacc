"""The operation log: versions, file vector, conflicts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table


def numbered(df: DataFrame, order: list[str], out: str = "version") -> DataFrame:
    """Consecutive numbers from 1 in a global order, without gathering rows in one task.

    Rows are dealt by range and sorted; what each partition holds is counted, and the counts before
    it are its offset. The sorted rows are written first, so that both readings see one division.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    fixed = shared_table(part, "numbered")
    sizes = fixed.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order)
    ranked = fixed.withColumn("__rank", F.row_number().over(w)).join(F.broadcast(offsets), "__part")
    return ranked.withColumn(out, (F.col("__before") + F.col("__rank")).cast("bigint")).drop("__part", "__before", "__rank")


def file_versions(log: DataFrame) -> DataFrame:
    """(file, version): the last version of each file."""
    return log.groupBy("file").agg(F.max("version").alias("version"))


def file_version(log: DataFrame, files: DataFrame) -> DataFrame:
    """Versions of the files asked for; 0 for those without any."""
    return files.join(file_versions(log), "file", "left").withColumn("version", F.coalesce("version", F.lit(0)))


def retained(log: DataFrame, keep: int = 1000) -> DataFrame:
    """The last ``keep`` operations, by version: versions are consecutive."""
    last = log.agg(F.max("version").alias("__last"))
    return log.join(F.broadcast(last), F.col("version") > F.col("__last") - keep).drop("__last")


def ops_since(log: DataFrame, base: int, keep: int | None = 1000) -> DataFrame:
    return (log if keep is None else retained(log, keep)).where(F.col("version") > base)


def conflicts(recent: DataFrame, proposed: DataFrame) -> DataFrame:
    """(prop_id, version, conflict, severity): proposed operations against later ones on the same node.

    ``recent`` (version, op_type, node_id, renamed_from), ``proposed`` (prop_id, op_type, node_id).
    A deletion wins over a rename, that over two updates.
    """
    p = proposed.select("prop_id", F.col("op_type").alias("mine"), "node_id")
    j = p.join(recent, "node_id")
    kind = F.when(F.col("op_type") == "remove_node", "deletion").when(F.col("renamed_from").isNotNull(), "rename").when((F.col("op_type") == "update_node") & (F.col("mine") == "update_node"), "concurrent_edit")
    out = j.withColumn("conflict", kind).where("conflict IS NOT NULL")
    return out.select("prop_id", "version", "conflict", F.when(F.col("conflict") == "deletion", "error").otherwise("warning").alias("severity"))


def stale_references(recent: DataFrame, proposed: DataFrame) -> DataFrame:
    """(prop_id, version, conflict, severity): proposals whose call list holds a name renamed since, as text."""
    old = recent.where("renamed_from IS NOT NULL").select("version", "renamed_from")
    text = proposed.select("prop_id", F.explode("calls").alias("call"))
    # names are few, and substrings are those of single calls: each call is cut into its parts to join on
    parts = text.select("prop_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("call")), lambda i: F.struct(i.alias("i")))).alias("s"), "call").select("prop_id", F.col("s.i").alias("i"), "call")
    size = old.select(F.length("renamed_from").alias("size")).distinct()
    cut = parts.join(F.broadcast(size), F.col("i") + F.col("size") - 1 <= F.length("call")).select("prop_id", F.expr("substring(call, i, size)").alias("renamed_from")).distinct()
    return cut.join(old, "renamed_from").select("prop_id", "version", F.lit("rename").alias("conflict"), F.lit("warning").alias("severity"))


def rename_fix(proposed: DataFrame, renamed: DataFrame) -> DataFrame:
    """``proposed`` (prop_id, names array) with renamed names replaced (old_name, new_name), in place."""
    p = proposed.select("prop_id", F.posexplode("names").alias("pos", "old_name"))
    m = renamed.groupBy("old_name").agg(F.max("new_name").alias("new_name"))
    fixed = p.join(m, "old_name", "left").select("prop_id", "pos", F.coalesce("new_name", "old_name").alias("name"))
    return fixed.groupBy("prop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def deletion_fix(proposed: DataFrame, recent: DataFrame) -> DataFrame:
    """Proposed operations whose node was not removed since."""
    gone = recent.where("op_type = 'remove_node'").select("node_id").distinct()
    return proposed.join(gone, "node_id", "left_anti")


def session_status(sessions: DataFrame, current: int) -> DataFrame:
    """Adds drift, status and can_apply to (session_id, base_version, known, n_proposed, n_conflicts)."""
    s = sessions.withColumn("drift", F.lit(current) - F.col("base_version"))
    status = F.when(~F.col("known"), "error").when(F.col("drift") == 0, "clean").when(F.col("n_proposed") == 0, "clean_with_drift").when(F.col("n_conflicts") > 0, "conflicts").otherwise("clean_with_drift")
    s = s.withColumn("status", status)
    return s.withColumn("can_apply", ~F.col("status").isin("error", "conflicts"))


def live_sessions(sessions: DataFrame, now: float, ttl: float = 300.0, most: int = 10) -> DataFrame:
    """Sessions neither completed nor older than ``ttl`` seconds, the ``most`` youngest."""
    live = sessions.where(~F.col("completed") & (F.lit(now) - F.col("started") <= ttl))
    return live.orderBy(F.desc("started"), F.desc("session_id")).limit(most)
