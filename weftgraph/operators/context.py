"""Context of files: nested views, budgets, summaries, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .lookup import ranked_in
from .stats import cross_edges


def file_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, entity, type, line_start, calls_out, called_by): a row for each node, its neighbours nested.

    Each list is an array of (name, file_path, edge_type), sorted; an id without a node stands for itself.
    """
    other = nodes.select(F.col("id").alias("oid"), F.col("name").alias("oname"), F.col("file_path").alias("ofile"))

    def side(near: str, far: str, out: str) -> DataFrame:
        e = edges.join(other, F.col(far) == F.col("oid"), "left")
        item = F.struct(F.coalesce("oname", far).alias("name"), F.coalesce("ofile", F.lit("")).alias("file_path"), "edge_type")
        return e.groupBy(F.col(near).alias("id")).agg(F.sort_array(F.collect_list(item)).alias(out))

    n = nodes.join(side("source_id", "target_id", "calls_out"), "id", "left").join(side("target_id", "source_id", "called_by"), "id", "left")
    return n.select("file_path", F.col("name").alias("entity"), "type", "line_start", "calls_out", "called_by")


def cross_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, name, type, line_start, n_cross_callers, n_cross_callees) of each node."""
    c = cross_edges(nodes, edges)
    i = c.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_cross_callers"))
    o = c.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_cross_callees"))
    n = nodes.join(i, "id", "left").join(o, "id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    return n.select("file_path", "name", "type", "line_start", zero("n_cross_callers"), zero("n_cross_callees"))


def key_entities(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` key entities of each file: classes first, then most cross-file callers, then by line.

    The head of each file is kept in an aggregate of bounded size, not in a window over the file.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy(F.when(F.col("type") == "class", 0).otherwise(1), F.desc("n_cross_callers"), "line_start", "name")
    return cross_counts(nodes, edges).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("n_cross_callees")


def caller_ranking(nodes: DataFrame, edges: DataFrame, top: int = 3, cross: int = 3, same: int = 2) -> DataFrame:
    """(file_path, place, name, n_cross, n_same, shown): the entities of each file that most other files' nodes refer to.

    ``shown`` names the first callers from other files (``file:name``), how many more there are, and
    the first from the same file; by file, name, edge type and id. Counts are aggregates; callers are
    listed for the chosen entities alone, and only the first few are gathered.
    """
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"))
    t = nodes.select(F.col("id").alias("target_id"), "name", "file_path", "line_start")
    own = ["target_id", "file_path", "name", "line_start"]
    calls = edges.select("source_id", "target_id", "edge_type").join(s, "source_id").join(t, "target_id").withColumn("other", F.col("caller_file") != F.col("file_path"))
    sums = calls.groupBy(*own).agg(F.count_if("other").alias("n_cross"), F.count_if(~F.col("other")).alias("n_same"))
    best = ranked_in(sums, ["file_path"], [F.desc("n_cross"), F.col("line_start"), F.col("name"), F.col("target_id")], top, "place")
    near = calls.join(best.select("target_id"), "target_id", "left_semi")
    near = ranked_in(near, ["target_id", "other"], [F.col("caller_file"), F.col("caller"), F.col("edge_type"), F.col("source_id")], max(cross, same), "k")
    label = F.when(F.col("other"), F.concat(N.base_name(F.col("caller_file")), F.lit(":"), F.col("caller"))).otherwise(F.concat("caller", F.lit(" (same file)")))
    kept = near.where(F.col("k") <= F.when(F.col("other"), cross).otherwise(same)).groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct((~F.col("other")).alias("own"), "k", label.alias("label")))).alias("x"))
    part = lambda own_file: F.transform(F.filter("x", lambda i: i["own"] == F.lit(own_file)), lambda i: i["label"])
    more = F.when(F.col("n_cross") > cross, F.array(F.concat(F.lit("+"), (F.col("n_cross") - cross).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return best.join(kept, "target_id").select("file_path", F.col("place").cast("bigint").alias("place"), "name", "n_cross", "n_same", F.array_join(F.concat(part(False), more, part(True)), ", ").alias("shown"))


def within_budget(parts: Column, budget: int) -> Column:
    """Of an array of strings those that fit ``budget`` characters in turn; one too long is skipped, not the end."""
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    fold = lambda a, x: F.when(a["used"] + F.length(x) <= budget, F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["used"] + F.length(x)).alias("used"))).otherwise(a)
    return F.aggregate(parts, zero, fold, lambda a: a["kept"])


def affected_grouping(files: DataFrame, by: str, least: int = 3, most: int = 5) -> DataFrame:
    """(by, listed): affected files (by, file_path) as text; three or more of a folder are one entry.

    Up to ``most`` entries are listed, else one less and how many more there are.
    """
    f = files.select(by, "file_path", N.parent_dir(F.col("file_path")).alias("folder"), N.base_name(F.col("file_path")).alias("base")).distinct()
    g = f.groupBy(by, "folder").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("base")).alias("bases"))
    entry = F.when((F.col("n") >= least) & (F.col("folder") != ""), F.array(F.concat("folder", F.lit("/ ("), F.col("n").cast("string"), F.lit(" files)")))).otherwise(F.col("bases"))
    e = g.select(by, F.explode(entry).alias("entry")).groupBy(by).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    n = F.size("entries")
    short = F.concat(F.array_join(F.slice("entries", 1, most - 1), ", "), F.lit(" +"), (n - (most - 1)).cast("string"), F.lit(" more"))
    return e.select(by, F.when(n <= most, F.array_join("entries", ", ")).otherwise(short).alias("listed"))


def diagram_edges(file_edges: DataFrame) -> DataFrame:
    """(line): file dependencies in Mermaid's syntax."""
    p = file_edges.select("source_file", "target_file").distinct()
    return p.select(F.concat(N.diagram_id(F.col("source_file")), F.lit(" --> "), N.diagram_id(F.col("target_file"))).alias("line"))


def mermaid(lines: list[str]) -> str:
    return "\n".join(["graph LR", *(f"    {x}" for x in sorted(lines))])


def dot(pairs: list[tuple[str, str]]) -> str:
    return "\n".join(["digraph deps {", *(f'  "{a}" -> "{b}";' for a, b in sorted(pairs)), "}"])


def signature(kind: Column, name: Column, params: Column) -> Column:
    """``def name(params)``, ``class name``, or the bare name."""
    listed = F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")"))
    return F.when(kind == "function", F.concat(F.lit("def "), N.bare(name), listed)).when(kind == "class", F.concat(F.lit("class "), name)).otherwise(name)


def summary(nodes: DataFrame, edges: DataFrame, k: int = 10) -> dict:
    """Counts by type, files and the first cross-file edges: a bounded report for the driver."""
    kinds = {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    cross = cross_edges(nodes, edges).select("source_name", "edge_type", "target_name", "target_file").orderBy("source_name", "edge_type", "target_name").limit(k).collect()
    return {"types": kinds, "edges": edges.count(), "files": nodes.select("file_path").distinct().count(), "cross": [f"{r[0]} --{r[1]}--> {r[2]} ({r[3]})" for r in cross]}


def format_node(kind: Column, name: Column, path: Column, line: Column) -> Column:
    """``[type] name (file:line)``."""
    return F.concat(F.lit("["), kind, F.lit("] "), name, F.lit(" ("), path, F.lit(":"), line.cast("string"), F.lit(")"))


def rich_context(nodes: DataFrame, edges: DataFrame, path: str, budget: int = 2000) -> str:
    """A file's context as text of at most ``budget`` characters: header, key entities, callers, callees, files it affects.

    Each list is cut to a few rows before it reaches the driver; a part that does not fit is left out whole.
    """
    from .lookup import file_edges, resolve_file

    found = resolve_file(nodes, path).first()
    if found is None:
        return ""
    at = found["file_path"]
    own = nodes.where(F.col("file_path") == at)
    kinds = {r["type"]: r["n"] for r in own.groupBy("type").agg(F.count("*").alias("n")).collect()}
    parts = [f"{at.rsplit('/', 1)[-1]}: {kinds.get('function', 0)}fn {kinds.get('class', 0)}cls"]

    def add(lines: list[str], share: int) -> None:
        used = 0
        for x in lines:
            if used + len(x) <= share and sum(map(len, parts)) + len(parts) + len(x) <= budget:
                parts.append(x)
                used += len(x)

    keys = [r for r in key_entities(own, edges.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi")).orderBy("place").collect()]
    add([f"{r['type']} {r['name']} :{r['line_start']}" for r in keys], (budget - len(parts[0])) // 5)
    into = edges.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    add([f"{r['name']} <- {r['shown']}" for r in caller_ranking(nodes, into).orderBy("place").collect()], budget * 2 // 5)
    f = file_edges(nodes, edges)
    deps = [r["target_file"] for r in f.where(F.col("source_file") == at).select("target_file").distinct().orderBy("target_file").limit(6).collect()]
    if deps:
        shown = [d.rsplit("/", 1)[-1] for d in deps]
        add(["deps: " + ", ".join(shown if len(shown) <= 5 else [*shown[:4], "+more"])], budget // 5)
    listed = affected_grouping(f.where(F.col("target_file") == at).select("target_file", F.col("source_file").alias("file_path")), "target_file").first()
    if listed:
        add(["affects: " + listed["listed"]], budget // 5)
    return "\n".join(parts)
