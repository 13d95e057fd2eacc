"""What a change of the graph should warn of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from .cycles import cyclic_files
from .dead import dead_code
from .lookup import file_edges, ranked_in
from .mutate import Graph

COLUMNS = ("kind", "file_path", "subject", "detail", "n")


def broken_callers(before: Graph, after: Graph, shown: int = 3) -> DataFrame:
    """Nodes that are gone though nodes that stay refer to them: the first callers' names, and how many there are.

    Callers are counted by name. Only the first few names of a node are ever gathered in a row.
    """
    gone = before.nodes.join(after.nodes.select("id"), "id", "left_anti").select("id", "file_path", F.col("name").alias("subject"))
    stay = after.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("caller"))
    pairs = before.edges.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(stay, "source_id").select(F.col("target_id").alias("id"), "caller").distinct()
    first = ranked_in(pairs, ["id"], [F.col("caller")], shown).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("caller")), ", ").alias("detail"))
    n = pairs.groupBy("id").agg(F.count("*").alias("n"))
    return gone.join(first, "id").join(n, "id").select(F.lit("broken").alias("kind"), "file_path", "subject", "detail", "n")


def change_alerts(before: Graph, after: Graph) -> DataFrame:
    """(kind, file_path, subject, detail, n): a change's broken callers, new unused entities and newly cyclic files.

    ``broken`` as in ``broken_callers``; ``unused`` are nodes that were added and that nothing refers
    to, by the rules of dead code; ``cycle`` are files on import cycles now that were on none before.
    """
    added = after.nodes.join(before.nodes.select("id"), "id", "left_anti").select("id")
    unused = dead_code(after.nodes, after.edges).join(added, "id", "left_semi")
    rings = [cyclic_files(shared_table(file_edges(g.nodes, g.edges), "files")) for g in (before, after)]
    cycle = rings[1].join(rings[0], "file_path", "left_anti").distinct()
    row = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), "file_path", F.col(subject).alias("subject"), F.lit("").alias("detail"), F.lit(0).cast("bigint").alias("n"))
    return broken_callers(before, after).unionByName(row(unused, "unused", "name")).unionByName(row(cycle, "cycle", "file_path"))
