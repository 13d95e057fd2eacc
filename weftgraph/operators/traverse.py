"""Traversals: breadth-first levels, reachability, paths, impact, neighbourhoods.

Up to ``UNROLL`` hops are one lazy plan: the level of a node is its shortest walk, so that levels
need no visited set. Deeper ones loop over a frontier, write each level to the shared folder and
stop when it is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

UNROLL = 4


def adjacency(edges: DataFrame, edge_types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """Distinct (at, to) pairs by which a traversal moves."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"))
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def levels(moves: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): what ``start`` (id) reaches within ``max_depth`` moves, start itself left out."""
    start = start.select("id").distinct()
    if max_depth <= UNROLL:
        frontier, found = start, []
        for d in range(1, max_depth + 1):
            frontier = moves.join(frontier.withColumnRenamed("id", "at"), "at", "left_semi").select(F.col("to").alias("id")).distinct()
            found.append(frontier.withColumn("depth", F.lit(d)))
        walked = reduce(DataFrame.unionByName, found)
        return walked.groupBy("id").agg(F.min("depth").alias("depth")).join(start, "id", "left_anti")
    moves = shared_table(moves, "moves")
    seen = shared_table(start.withColumn("depth", F.lit(0)), "level")
    frontier = seen
    for d in range(1, max_depth + 1):
        step = moves.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = shared_table(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def traverse(nodes: DataFrame, edges: DataFrame, start: DataFrame, edge_types: list[str] | None = None, direction: str = "out", max_depth: int = 3) -> DataFrame:
    """Nodes reached, with their depth; ids without a node are passed through, but not reported."""
    found = levels(adjacency(edges, edge_types, direction), start, max_depth)
    return nodes.join(found, "id").select("id", "name", "type", "file_path", "depth")


def reachable(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, reachable) for each of ``targets`` (id): whether some source reaches it; a source reaches itself."""
    found = levels(adjacency(edges), sources, max_depth).select("id").unionByName(sources.select("id")).distinct()
    return targets.select("id").distinct().join(found.withColumn("reachable", F.lit(True)), "id", "left").select("id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def shortest_paths(edges: DataFrame, start: DataFrame, max_depth: int = 10, direction: str = "out") -> DataFrame:
    """(id, hops, path): a shortest path from a start to each node reached, ids joined by ``>``.

    Of paths of one length the smallest stands, as ids have one length and prefixes compare first.
    """
    moves = adjacency(edges, None, direction)
    first = start.select("id").distinct().select("id", F.lit(0).alias("hops"), F.col("id").alias("path"))
    deep = max_depth > UNROLL
    if deep:
        moves, first = shared_table(moves, "moves"), shared_table(first, "paths")
    walks, frontier = first, first
    for d in range(1, max_depth + 1):
        step = moves.join(frontier.select(F.col("id").alias("at"), F.col("path").alias("so_far")), "at")
        frontier = step.groupBy(F.col("to").alias("id")).agg(F.min(F.concat_ws(">", "so_far", "to")).alias("path")).select("id", F.lit(d).alias("hops"), "path")
        if deep:
            frontier = shared_table(frontier.join(walks.select("id"), "id", "left_anti"), "paths")
            if frontier.isEmpty():
                break
        walks = walks.unionByName(frontier)
    # unrolled, a level is all walks of its length, one to a node: the shortest is the node's path, and the
    # plan has one join and one aggregate a hop
    return walks.groupBy("id").agg(F.min(F.struct("hops", "path")).alias("x")).select("id", "x.hops", "x.path")


def file_moves(file_edges: DataFrame, edge_types: list[str] | None, direction: str) -> DataFrame:
    e = file_edges if not edge_types else file_edges.where(F.col("edge_type").isin(edge_types))
    e = e.select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"), "edge_type")
    return adjacency(e, None, direction)


def impact(file_edges: DataFrame, path: str, max_depth: int = 3, named: DataFrame | None = None) -> DataFrame:
    """(file_path): the files that a change of ``path`` affects, itself left out.

    Seeds are files with any edge into it, and ``named`` (file_path), those that mention a changed
    name; from there calls, imports and inheritance lead on for ``max_depth`` - 1 rounds.
    """
    seeds = file_edges.where(F.col("target_file") == path).select(F.col("source_file").alias("id"))
    if named is not None:
        seeds = seeds.unionByName(named.select(F.col("file_path").alias("id")))
    seeds = seeds.where(F.col("id") != path).distinct()
    more = levels(file_moves(file_edges, ["calls", "imports", "inherits"], "in"), seeds, max_depth - 1).select("id") if max_depth > 1 else seeds
    return seeds.unionByName(more).distinct().where(F.col("id") != path).select(F.col("id").alias("file_path"))


def file_neighbourhood(file_edges: DataFrame, path: str, max_depth: int = 2) -> DataFrame:
    """(file_path, depth) of files within ``max_depth`` edges, either way, the file itself at 0."""
    start = file_edges.sparkSession.createDataFrame([(path,)], "id string")
    found = levels(file_moves(file_edges, None, "both"), start, max_depth)
    return start.withColumn("depth", F.lit(0)).unionByName(found).select(F.col("id").alias("file_path"), "depth")


def inheritance(nodes: DataFrame, edges: DataFrame, part: str = "") -> DataFrame:
    """(child, parent) names of inherits edges where either holds ``part``."""
    c = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("child"))
    p = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("parent"))
    e = edges.where("edge_type = 'inherits'").join(c, "source_id").join(p, "target_id").select("child", "parent")
    return e.where(F.col("child").contains(part) | F.col("parent").contains(part)) if part else e


def call_graph(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """Edges that leave nodes within ``max_depth`` of a start: so they end at ``max_depth`` + 1."""
    near = levels(adjacency(edges, ["calls"]), start, max_depth).select("id").unionByName(start.select("id")).distinct()
    return edges.where("edge_type = 'calls'").join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi")


def ancestors(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id, ancestor, depth): closure of inherits over ``max_depth`` steps (classes are few and shallow)."""
    up = edges.where("edge_type = 'inherits'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ancestor")).distinct()
    level, found = up.withColumn("depth", F.lit(1)), []
    for d in range(1, max_depth + 1):
        found.append(level)
        if d < max_depth:
            nxt = up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"))
            level = level.join(nxt, "ancestor").select("id", F.col("above").alias("ancestor"), F.lit(d + 1).alias("depth")).distinct()
    return reduce(DataFrame.unionByName, found).groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): connected components of an undirected graph, by smallest-neighbour rounds with shortcuts."""
    both = shared_table(adjacency(edges, None, "both"), "both")
    label = shared_table(both.select(F.col("at").alias("id")).distinct().withColumn("root", F.col("id")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("to"), F.col("root").alias("seen")), "to").groupBy(F.col("at").alias("id")).agg(F.min("seen").alias("seen"))
        low = label.join(near, "id").select("id", "root", F.least("root", "seen").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("root").alias("beyond"))
        new = shared_table(low.join(jump, "low").select("id", F.least("low", "beyond").alias("new"), F.col("root").alias("old")), "label")
        done = new.where("new <> old").isEmpty()
        label = new.select("id", F.col("new").alias("root"))
        if done:
            return label
