"""Dead code, and what keeps overrides and nested functions alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import shared_table
from .traverse import ancestors


def override_live(nodes: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id): methods that override one which is called, or decorated, in an ancestor class.

    A method's class is the class node named by all before its last dot, in the same file if there is
    one, else the first elsewhere by file.
    """
    methods = nodes.where("type = 'function' AND instr(name, '.') > 0").select("id", N.qualifier(F.col("name")).alias("class_name"), N.bare(F.col("name")).alias("method"), "file_path")
    classes = nodes.where("type = 'class'").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.col("file_path").alias("class_file"))
    owned = methods.join(classes, "class_name").groupBy("id", "method").agg(F.min_by("class_id", F.struct(F.col("class_file") != F.col("file_path"), "class_file")).alias("class_id"))
    above = ancestors(edges, max_depth).select(F.col("id").alias("class_id"), "ancestor")
    up = owned.join(above, "class_id").join(classes.select(F.col("class_id").alias("ancestor"), F.col("class_name").alias("parent")), "ancestor")
    up = up.select("id", F.concat_ws(".", "parent", "method").alias("name"))
    called = edges.select(F.col("target_id").alias("pid")).distinct()
    abstract = F.array_contains("decorators", "abstractmethod") if "decorators" in nodes.columns else F.lit(False)
    parents = nodes.where("type = 'function'").select(F.col("id").alias("pid"), "name", abstract.alias("abstract"))
    live = parents.join(called.withColumn("hit", F.lit(True)), "pid", "left").where("hit OR abstract").select("name").distinct()
    return up.join(live, "name", "left_semi").select("id").distinct()


def dead_code(nodes: DataFrame, edges: DataFrame, include_tests: bool = False, include_framework: bool = False, passive: tuple[str, ...] = N.PASSIVE_TYPES) -> DataFrame:
    """Nodes that nothing refers to, and that no rule excuses."""
    name, short = F.col("name"), N.bare(F.col("name"))
    n = nodes.where(~name.isin(*N.ENTRY_NAMES) & ~F.col("type").isin(*(passive or N.PASSIVE_TYPES)) & ~N.is_dunder(short))
    if not include_tests:
        n = n.where(~N.is_test_file(F.col("file_path")))
    if not include_framework:
        for p in N.FRAMEWORK_PREFIXES:
            n = n.where(~F.startswith(short, F.lit(p)))
    if "decorators" in nodes.columns:
        n = n.where(~F.coalesce(F.array_contains("decorators", "property"), F.lit(False)))
    # both are read twice: written once, so that the plan holds the edges' own plan once each
    used = shared_table(edges.select(F.col("target_id").alias("id")).distinct(), "used")
    live = shared_table(override_live(nodes, edges), "live")
    n = n.join(used, "id", "left_anti").join(live, "id", "left_anti")
    # nested two levels deep in a method that is called or overrides
    alive = nodes.join(used.unionByName(live).distinct(), "id", "left_semi").select(F.col("name").alias("outer")).distinct()
    deep = n.withColumn("outer", F.when(F.length("name") - F.length(F.replace("name", F.lit("."))) >= 2, N.qualifier(name)))
    return deep.join(alive, "outer", "left_anti").select("id", "name", "type", "file_path", "line_start")
