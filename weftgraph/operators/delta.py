"""From two versions of a file's entities to operations on the graph.

Entities are rows (file_path, seq, name, type, sig, struct, line_start, line_end, ord) of the version
``seq`` of a file. Of entities of one name in a version the last counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_path", "seq"]


def by_name(entities: DataFrame) -> DataFrame:
    """One row for each name of a version: the last by ``ord``."""
    fields = [c for c in entities.columns if c not in (*KEY, "name")]
    last = entities.groupBy(*KEY, "name").agg(F.max_by(F.struct(*fields), "ord").alias("e"))
    return last.select(*KEY, "name", *[F.col(f"e.{c}").alias(c) for c in fields])


def semantic_gate(versions: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path, seq, passes) for each of ``versions`` (file_path, seq, blank).

    A version passes if its set of (name, sig) differs from its predecessor's, unless it has text but
    no entities where the predecessor had some.
    """
    sets = entities.groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "name", "sig"))), "|"), 256).alias("now"))
    v = versions.join(sets, KEY, "left").withColumn("now", F.coalesce("now", F.lit("")))
    w = Window.partitionBy("file_path").orderBy("seq")
    before = F.coalesce(F.lag("now").over(w), F.lit(""))
    v = v.withColumn("before", before)
    broken = (F.col("now") == "") & ~F.col("blank") & (F.col("before") != "")
    return v.select(*KEY, ((F.col("now") != F.col("before")) & ~broken).alias("passes"))


def _paired(versions: DataFrame, entities: DataFrame) -> DataFrame:
    """Old and new entities of each version side by side, by name (full outer)."""
    e = by_name(entities)
    w = Window.partitionBy("file_path").orderBy("seq")
    after = versions.select("file_path", F.col("seq").alias("old_seq"), F.lead("seq").over(w).alias("seq")).where("seq IS NOT NULL")
    side = lambda p: F.struct("type", "sig", "struct", "line_start", "line_end").alias(p)
    new = e.join(versions.select(*KEY), KEY, "left_semi").select(*KEY, "name", side("new"))
    old = e.select("file_path", F.col("seq").alias("old_seq"), "name", side("old")).join(after, ["file_path", "old_seq"]).select(*KEY, "name", "old")
    return new.join(old, [*KEY, "name"], "full_outer")


def delta_rows(versions: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path, seq, name, kind): added, removed and modified entities of each version, renames included."""
    p = _paired(versions, entities)
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.sig") != F.col("new.sig"), "modified")
    d = p.withColumn("kind", kind).where("kind IS NOT NULL")
    r = renames(versions, entities, d)
    gone = r.select(*KEY, F.col("old_name").alias("name"), F.lit("removed").alias("kind")).unionByName(r.select(*KEY, F.col("new_name").alias("name"), F.lit("added").alias("kind")))
    rest = d.select(*KEY, "name", "kind").join(gone, [*KEY, "name", "kind"], "left_anti").withColumn("old_name", F.lit(None).cast("string"))
    return rest.unionByName(r.select(*KEY, F.col("new_name").alias("name"), F.lit("modified").alias("kind"), "old_name"))


def renames(versions: DataFrame, entities: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """(file_path, seq, old_name, new_name): removed and added entities that are one renamed.

    They have one type and structure and overlapping lines. Of several the pair stands that is each
    other's first, by (line_start, name); a total order where sets would decide by chance.
    """
    if diff is None:
        p = _paired(versions, entities)
        diff = p.withColumn("kind", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed"))
    rem = diff.where("kind = 'removed'").select(*KEY, F.col("name").alias("old_name"), F.col("old").alias("o"), F.col("old.type").alias("type"), F.col("old.struct").alias("struct"))
    add = diff.where("kind = 'added'").select(*KEY, F.col("name").alias("new_name"), F.col("new").alias("n"), F.col("new.type").alias("type"), F.col("new.struct").alias("struct"))
    c = rem.join(add, [*KEY, "type", "struct"]).where("o.line_start <= n.line_end AND n.line_start <= o.line_end")
    first = Window.partitionBy(*KEY, "old_name").orderBy("n.line_start", "new_name")
    second = Window.partitionBy(*KEY, "new_name").orderBy("o.line_start", "old_name")
    c = c.withColumn("a", F.row_number().over(first)).withColumn("b", F.row_number().over(second))
    return c.where("a = 1 AND b = 1").select(*KEY, "old_name", "new_name")


def op_feed(delta: DataFrame) -> DataFrame:
    """Adds op_type and place: removals, then additions (imports first, by name), then modifications."""
    op = F.when(F.col("kind") == "removed", "remove_node").when(F.col("kind") == "added", "add_node").otherwise("update_node")
    rank = F.when(F.col("kind") == "removed", 0).when(F.col("kind") == "added", 1).otherwise(2)
    imports = F.when(F.col("type") == "import", 0).otherwise(1) if "type" in delta.columns else F.lit(1)
    w = Window.partitionBy(*KEY).orderBy("rank", "later", "name")
    d = delta.withColumn("op_type", op).withColumn("rank", rank).withColumn("later", imports)
    return d.withColumn("place", F.row_number().over(w)).drop("rank", "later")


def had_callers(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, had_callers): for nodes about to go, the names of those in other files that refer to them."""
    g = gone.select(F.col("id").alias("target_id"), F.col("file_path").alias("own_file"))
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"))
    e = edges.join(g, "target_id").join(s, "source_id").where("own_file <> caller_file").select("target_id", "caller").distinct()
    return e.groupBy(F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("had_callers"))


def positions_overlap(a_start, a_end, b_start, b_end):
    """Equal starts, or intervals that meet."""
    return (a_start == b_start) | ((a_start <= b_end) & (b_start <= a_end))
