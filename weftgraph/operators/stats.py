"""Counts, histograms, top lists and the graph's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import qualifier


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))  # one row with one row


def top_classes(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The classes with most dotted functions."""
    m = nodes.where("type = 'function' AND instr(name, '.') > 0").groupBy(qualifier(F.col("name")).alias("class_name")).agg(F.count("*").alias("n_methods"))
    return m.orderBy(F.desc("n_methods"), "class_name").limit(k)


def cross_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different files, with both ends' files."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name"))
    return edges.join(s, "source_id").join(t, "target_id").where("source_file <> target_file")


def fan(nodes: DataFrame, edges: DataFrame, incoming: bool, k: int = 10) -> DataFrame:
    """The names with most cross-file edges in or out; of nodes with one name the last by file and line stands."""
    own, end = ("target_id", "n_in") if incoming else ("source_id", "n_out")
    n = cross_edges(nodes, edges).groupBy(F.col(own).alias("id")).agg(F.count("*").alias("n"))
    last = F.max_by("n", F.struct("file_path", "line_start", "id"))
    by_name = n.join(nodes.select("id", "name", "file_path", "line_start"), "id").groupBy("name").agg(last.alias(end))
    return by_name.orderBy(F.desc(end), "name").limit(k)


def hot_files(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The files with most cross-file edges, in and out together."""
    c = cross_edges(nodes, edges)
    both = c.select(F.explode(F.array("source_file", "target_file")).alias("file_path"))
    return both.groupBy("file_path").agg(F.count("*").alias("n_edges")).orderBy(F.desc("n_edges"), "file_path").limit(k)


def entities_per_file(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file_path").agg(F.count("*").alias("n_entities"), F.countDistinct("type").alias("n_types"))


def resolution_rate(references: DataFrame) -> DataFrame:
    """Of references (resolved, ambiguous, external booleans): counts, the rate, and that without externals."""
    a = references.agg(
        F.count("*").alias("total"),
        F.count_if("resolved").alias("resolved"),
        F.count_if("ambiguous").alias("ambiguous"),
        F.count_if("external").alias("external"),
    )
    share = lambda n, d: F.when(d > 0, F.round(n / d, 6)).otherwise(0.0)
    return a.withColumn("rate", share(F.col("resolved"), F.col("total"))).withColumn("effective_rate", share(F.col("resolved"), F.col("total") - F.col("external")))


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a hash of the graph that no order changes.

    Each node's and edge's text is hashed; the 256 bits are summed in four 64-bit lanes, so that the
    hash is a distributed aggregate and equal graphs are equal however they were built.
    """
    n = nodes.select(F.concat_ws(":", F.lit("n"), "id", "type", "name", "file_path").alias("t"))
    e = edges.select(F.concat_ws(":", F.lit("e"), "source_id", "target_id", "edge_type").alias("t"))
    h = n.unionByName(e).select(F.sha2("t", 256).alias("h"))
    # 15 hex digits fit a signed 64-bit number; sums are kept as decimals
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return h.agg(F.left(F.sha2(F.concat_ws("|", *lanes, F.count("*").cast("string")), 256), F.lit(16)).alias("graph_hash"), F.count("*").alias("n_parts"))


def dependency_index(calls: DataFrame) -> DataFrame:
    """(name, n_files): in how many files each name of ``calls`` (file_path, name) is called."""
    return calls.groupBy("name").agg(F.countDistinct("file_path").alias("n_files"))


def unresolved_calls(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, n): called names (name, a row a call) that match no resolved name (name).

    Names match if they are equal or one ends with the other after a dot. Both ways are equi-joins:
    a name is looked up among the dotted ends of the resolved ones, and its own ends among these.
    """
    parts = F.split("name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    n = calls.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    known = resolved.where("name IS NOT NULL").select("name").distinct()
    inside = known.select(F.explode(ends).alias("name")).distinct()
    left = n.join(inside, "name", "left_anti")
    longer = left.select("name", F.explode(ends).alias("end")).join(known.select(F.col("name").alias("end")), "end", "left_semi").select("name").distinct()
    return left.join(longer, "name", "left_anti")
