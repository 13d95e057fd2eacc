"""Reversible operations on a graph of immutable DataFrames.

An operation takes a graph and gives the graph after it; what it needs to be undone it reads from the
graph before it. A batch checks all preconditions on the graph that each operation meets, and is
applied as a whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def add_nodes(g: Graph, new: DataFrame) -> Graph:
    """Nodes that are not there yet, by id."""
    return replace(g, nodes=g.nodes.unionByName(new.join(g.nodes.select("id"), "id", "left_anti"), allowMissingColumns=True))


def remove_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Nodes (id) and the edges at either end."""
    gone = gone.select("id").distinct()
    edges = g.edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return Graph(g.nodes.join(gone, "id", "left_anti"), edges.select(*g.edges.columns))


def restore(g: Graph, before: Graph, gone: DataFrame) -> Graph:
    """Undo of ``remove_nodes``: the nodes, and the edges of both directions."""
    gone = gone.select("id").distinct()
    nodes = before.nodes.join(gone, "id", "left_semi")
    key = ["source_id", "target_id", "edge_type"]
    lost = before.edges.join(g.edges.select(*key).distinct(), key, "left_anti").select(*before.edges.columns)
    touching = lost.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(lost.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_semi")).distinct()
    return Graph(g.nodes.unionByName(nodes), g.edges.unionByName(touching.select(*g.edges.columns)))


def update_nodes(g: Graph, changes: DataFrame) -> Graph:
    """Set columns of nodes: ``changes`` has id and the columns, of which null leaves as it is."""
    columns = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    j = g.nodes.join(new, "id", "left")
    return replace(g, nodes=j.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in g.nodes.columns]))


def rename_nodes(g: Graph, names: DataFrame) -> Graph:
    """New names (id, name); ids stay."""
    return update_nodes(g, names.select("id", "name"))


def move_nodes(g: Graph, places: DataFrame) -> Graph:
    """New places (id, file_path, line_start)."""
    return update_nodes(g, places.select("id", "file_path", "line_start"))


def add_edges(g: Graph, new: DataFrame) -> Graph:
    return replace(g, edges=g.edges.unionByName(new, allowMissingColumns=True))


def remove_edges(g: Graph, gone: DataFrame) -> Graph:
    """One edge of each (source_id, target_id, edge_type) given, though several may be alike."""
    from pyspark.sql import Window

    key = ["source_id", "target_id", "edge_type"]
    w = Window.partitionBy(*key).orderBy(*[c for c in g.edges.columns if c not in key] or key)
    g_ = g.edges.withColumn("__n", F.row_number().over(w)).join(gone.select(*key).distinct().withColumn("__gone", F.lit(1)), key, "left")
    return replace(g, edges=g_.where("NOT (__gone IS NOT NULL AND __n = 1)").select(*g.edges.columns))


def retarget_edges(g: Graph, moves: DataFrame) -> Graph:
    """Edges (source_id, target_id, edge_type) to ``new_target``, with their other columns."""
    j = g.edges.join(moves, ["source_id", "target_id", "edge_type"], "left")
    return replace(g, edges=j.select(*[F.coalesce("new_target", "target_id").alias(c) if c == "target_id" else F.col(c) for c in g.edges.columns]))


def remove_file(g: Graph, path: str) -> Graph:
    return remove_nodes(g, g.nodes.where(F.col("file_path") == path))


def effective(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ops`` (place, op_type, node_id) with ok: whether each finds its node as it needs, in order.

    A node exists before an operation if the last add or remove before it added it, or if there was
    none and it is in ``nodes``; adding needs it gone, all else needs it there.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op_type") == "add_node", True).when(F.col("op_type") == "remove_node", False), ignorenulls=True).over(w)
    have = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("__there")).distinct()
    j = ops.join(have, "node_id", "left").withColumn("__is", F.coalesce(state, F.col("__there"), F.lit(False)))
    return j.withColumn("ok", F.when(F.col("op_type") == "add_node", ~F.col("__is")).otherwise(F.col("__is"))).drop("__is", "__there")


def batch_status(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(batch_id, n_ops, n_failed, applied) of ``ops`` (batch_id, place, op_type, node_id), each batch on its own."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch_id", "node_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op_type") == "add_node", True).when(F.col("op_type") == "remove_node", False), ignorenulls=True).over(w)
    have = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("__there")).distinct()
    j = ops.join(have, "node_id", "left").withColumn("__is", F.coalesce(state, F.col("__there"), F.lit(False)))
    ok = F.when(F.col("op_type") == "add_node", ~F.col("__is")).otherwise(F.col("__is"))
    s = j.groupBy("batch_id").agg(F.count("*").alias("n_ops"), F.count_if(~ok).alias("n_failed"))
    return s.withColumn("applied", F.col("n_failed") == 0)
