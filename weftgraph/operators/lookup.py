"""Point lookups, filters and one-hop joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_filter(nodes: DataFrame, file_path: str | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """All criteria given; none: every node."""
    for column, value in (("file_path", file_path), ("type", kind), ("name", name)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes


def name_search(nodes: DataFrame, pattern: str, file_path: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes whose name holds the pattern, by file and line."""
    return node_filter(nodes, file_path, kind).where(F.col("name").rlike(pattern)).orderBy("file_path", "line_start", "name")


def by_id(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("id") == node)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """One node of that name: the first by file, line and id."""
    return nodes.where(F.col("name") == name).orderBy("file_path", "line_start", "id").limit(1)


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of the name; if there are none, of a name that ends with ``.name``; else that match it as a pattern.

    ``pattern`` errors find nothing. The best rank is found by an aggregate of one row, so that no
    window gathers all nodes.
    """
    import re

    try:
        re.compile(name)
        pattern = F.col("name").rlike(name)
    except re.error:
        pattern = F.lit(False)
    rank = F.when(F.col("name") == name, 0).when(F.endswith("name", F.lit("." + name)), 1).when(pattern, 2)
    ranked = nodes.withColumn("rank", rank).where("rank IS NOT NULL")
    best = ranked.agg(F.min("rank").alias("best"))
    return ranked.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("rank", "best")


def resolve_file(nodes: DataFrame, path: str) -> DataFrame:
    """(file_path): the file itself, else the first by name that ends with or holds ``path``."""
    files = nodes.select("file_path").distinct()
    rank = F.when(F.col("file_path") == path, 0).when(F.endswith("file_path", F.lit(path)), 1).when(F.col("file_path").contains(path), 2)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "file_path").limit(1).select("file_path")


def _one_hop(nodes: DataFrame, edges: DataFrame, name: str, near: str, far: str, high_only: bool) -> DataFrame:
    chosen = resolve(nodes, name).select(F.col("id").alias(near), F.col("name").alias("of_name"))
    e = edges.where(F.col("confidence") == "high") if high_only else edges
    other = nodes.select(F.col("id").alias(far), F.col("name"), F.col("type"), F.col("file_path"), F.col("line_start"))
    hop = e.join(chosen, near).join(other, far, "left")
    return hop.select("of_name", F.coalesce("name", far).alias("name"), "type", "file_path", "line_start", "edge_type", "confidence")


def callers(nodes: DataFrame, edges: DataFrame, name: str, high_only: bool = False) -> DataFrame:
    """Sources of edges into the nodes that ``name`` resolves to; an id without a node stands for itself."""
    return _one_hop(nodes, edges, name, "target_id", "source_id", high_only)


def callees(nodes: DataFrame, edges: DataFrame, name: str, high_only: bool = False) -> DataFrame:
    return _one_hop(nodes, edges, name, "source_id", "target_id", high_only)


def file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, target_file, edge_type, n): edges between files, counted."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file"))
    e = edges.select("source_id", "target_id", "edge_type").join(s, "source_id").join(t, "target_id")
    return e.where("source_file <> target_file").groupBy("source_file", "target_file", "edge_type").agg(F.count("*").alias("n"))


def file_deps(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(file_path, dep, edge_type): the files that a file's edges lead to."""
    of = resolve_file(nodes, path)
    f = file_edges(nodes, edges).join(of, F.col("source_file") == F.col("file_path"), "left_semi")
    return f.select(F.col("source_file").alias("file_path"), F.col("target_file").alias("dep"), "edge_type")


def file_rdeps(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    of = resolve_file(nodes, path)
    f = file_edges(nodes, edges).join(of, F.col("target_file") == F.col("file_path"), "left_semi")
    return f.select(F.col("target_file").alias("file_path"), F.col("source_file").alias("dep"), "edge_type")


def degree(edges: DataFrame, end: str, name: str) -> DataFrame:
    """(id, name): how many edges leave (``source_id``) or reach (``target_id``) each node."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))


def file_entities(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """A file's nodes by line, with their numbers of edges out and in."""
    own = nodes.join(resolve_file(nodes, path), "file_path", "left_semi")
    n = own.join(degree(edges, "source_id", "n_out"), "id", "left").join(degree(edges, "target_id", "n_in"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return n.select("name", "type", "file_path", "line_start", zero("n_out"), zero("n_in")).orderBy("line_start", "name")


def entity_detail(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """A row for each node that ``name`` resolves to, with its neighbours' names, sorted, as text."""
    chosen = resolve(nodes, name)
    ids = chosen.select("id")
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def listed(near: str, far: str, out: str) -> DataFrame:
        e = edges.select(F.col(near).alias("id"), F.col(far).alias("other"), "edge_type").join(ids, "id", "left_semi")
        label = F.concat_ws(":", "edge_type", F.coalesce("other_name", "other"))
        return e.join(names, "other", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(label)), ",").alias(out))

    full = chosen.join(listed("source_id", "target_id", "out_edges"), "id", "left").join(listed("target_id", "source_id", "in_edges"), "id", "left")
    return full.select("id", "name", "type", "file_path", "line_start", F.coalesce("out_edges", F.lit("")).alias("out_edges"), F.coalesce("in_edges", F.lit("")).alias("in_edges"))


def exports(nodes: DataFrame) -> DataFrame:
    """(file_path, name): what ``__all__`` lists, or a file's top-level names where it has none.

    ``nodes`` may have ``uses``, the names that an ``__all__`` variable lists.
    """
    uses = F.col("uses") if "uses" in nodes.columns else F.array().cast("array<string>")
    listed = nodes.where("name = '__all__'").select("file_path", F.explode(uses).alias("name")).distinct()
    having = nodes.where("name = '__all__'").select("file_path").distinct()
    plain = nodes.where("instr(name, '.') = 0 AND name <> '__all__' AND type IN ('function', 'class', 'variable')")
    return listed.unionByName(plain.join(having, "file_path", "left_anti").select("file_path", "name").distinct())


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source_id", "target_id", "edge_type"])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked_in(df: DataFrame, part: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= k)


def entity_at_line(spans: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """(by, line, entity): of ``spans`` (by, entity, first, last, depth) the deepest that holds each of ``lines`` (by, line).

    Ties go to the smallest entity. One equi-join by file; a line that no span holds has no row.
    """
    at = lines.join(spans, by).where("line BETWEEN first AND last")
    best = F.min(F.struct((-F.col("depth")).alias("d"), "entity")).alias("x")
    return at.groupBy(by, "line").agg(best).select(by, "line", F.col("x.entity").alias("entity"))


def scope_lookup(scopes: DataFrame, defined: DataFrame, by: str) -> DataFrame:
    """(by, owner, level): of ``scopes`` (by, chain, name) the definition of the name in the innermost scope that has one.

    ``chain`` are the scope's parts, outermost first; ``defined`` has (scope, name, owner), the scope
    joined by ``::``. Level 0 is the outermost, empty scope.
    """
    levels = F.transform(F.sequence(F.lit(0), F.size("chain")), lambda i: F.array_join(F.slice("chain", F.lit(1), i), "::"))
    looks = scopes.select(by, "name", F.posexplode(levels).alias("level", "scope"))
    return looks.join(defined, ["scope", "name"]).groupBy(by).agg(F.max_by("owner", "level").alias("owner"), F.max("level").cast("bigint").alias("level"))


def prompt_mentions(prompts: DataFrame, nodes: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(by, place, token, kind, found): what the words of a prompt (by, text) name, ``most`` at most.

    A word of two characters or more is an entity's name (found: its first node's ``file:line``), or
    else a part of a file's path (found: the first such file). Entities come first, then by word.
    Parts of paths are an equi-join: each path gives its substrings, and each substring keeps its
    first file before the join.
    """
    words = prompts.select(by, F.explode(F.split("text", r"[\s,;:?!`'\"()\[\]{}]+")).alias("token")).select(by, F.btrim("token", F.lit("./")).alias("token"))
    words = words.where(F.length("token") >= 2).distinct()
    tokens = words.select("token").distinct()
    first = nodes.groupBy(F.col("name").alias("token")).agg(F.min(F.struct("file_path", "line_start")).alias("x"))
    named = tokens.join(first, "token").select("token", F.lit("entity").alias("kind"), F.concat_ws(":", "x.file_path", F.col("x.line_start").cast("string")).alias("found"))
    n = F.length("file_path")
    starts = F.explode(F.sequence(F.lit(1), n - 1)).alias("a")
    parts = nodes.select("file_path").where(n >= 2).distinct().select("file_path", starts).select("file_path", "a", F.explode(F.sequence(F.lit(2), n - F.col("a") + 1)).alias("size"))
    parts = parts.groupBy(F.substring("file_path", F.col("a"), F.col("size")).alias("token")).agg(F.min("file_path").alias("found"))
    files = tokens.join(named, "token", "left_anti").join(parts, "token").select("token", F.lit("file").alias("kind"), "found")
    hits = words.join(named.unionByName(files), "token")
    out = ranked_in(hits, [by], [F.col("kind"), F.col("token")], most, "place")
    return out.select(by, F.col("place").cast("bigint").alias("place"), "token", "kind", "found")
