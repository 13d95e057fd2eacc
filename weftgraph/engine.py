"""The commands of the engine over one graph, by name and by question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import router
from .operators import context, cycles, dead, lookup, stats, traverse
from .operators.mutate import Graph


class Engine:
    """Query commands; each returns a lazy DataFrame, ``render`` its first rows as text."""

    def __init__(self, graph: Graph):
        self.nodes, self.edges = graph.nodes, graph.edges

    def callers(self, name: str, high_only: bool = False) -> DataFrame:
        return lookup.callers(self.nodes, self.edges, name, high_only)

    def callees(self, name: str, high_only: bool = False) -> DataFrame:
        return lookup.callees(self.nodes, self.edges, name, high_only)

    def deps(self, path: str) -> DataFrame:
        return lookup.file_deps(self.nodes, self.edges, path)

    def rdeps(self, path: str) -> DataFrame:
        return lookup.file_rdeps(self.nodes, self.edges, path)

    def file(self, path: str) -> DataFrame:
        return lookup.file_entities(self.nodes, self.edges, path)

    def entity(self, name: str) -> DataFrame:
        return lookup.entity_detail(self.nodes, self.edges, name)

    def impact(self, path: str, name: str | None = None) -> DataFrame:
        """Files affected by a change of a file, or of one name in it (then files that call the name too)."""
        found = lookup.resolve_file(self.nodes, path).first()
        named = None
        if name is not None and "calls" in self.nodes.columns:
            named = self.nodes.where(F.exists("calls", lambda c: (c == name) | F.endswith(c, F.lit("." + name)))).select("file_path").distinct()
        return traverse.impact(lookup.file_edges(self.nodes, self.edges), found["file_path"] if found else path, named=named)

    def dead(self, everything: bool = False) -> DataFrame:
        return dead.dead_code(self.nodes, self.edges, include_tests=everything, include_framework=everything)

    def cycles(self, include_tests: bool = False) -> DataFrame:
        return cycles.minimal_cycles(lookup.file_edges(self.nodes, self.edges), include_tests)

    def path(self, source: str, target: str) -> DataFrame:
        """A shortest path from a node of one name to one of the other: hops and names."""
        ends = lookup.resolve(self.nodes, target).select("id")
        p = traverse.shortest_paths(self.edges, lookup.resolve(self.nodes, source), 10).join(ends, "id", "left_semi").orderBy("hops", "path").limit(1)
        steps = p.select("hops", F.posexplode(F.split("path", ">")).alias("step", "id"))
        return steps.join(self.nodes.select("id", "name", "file_path"), "id", "left").select("hops", "step", F.coalesce("name", "id").alias("name"), "file_path").orderBy("step")

    def search(self, pattern: str) -> DataFrame:
        return lookup.name_search(self.nodes, pattern)

    def exports(self, path: str) -> DataFrame:
        return lookup.exports(self.nodes.join(lookup.resolve_file(self.nodes, path), "file_path", "left_semi"))

    def summary(self) -> DataFrame:
        """Top lists in one table: (list, key, n)."""
        part = lambda df, name, key, n: df.select(F.lit(name).alias("list"), F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))
        out = part(stats.histogram(self.nodes, "type"), "types", "type", "n")
        for df, name, key, n in ((stats.top_classes(self.nodes), "classes", "class_name", "n_methods"), (stats.fan(self.nodes, self.edges, True), "fan_in", "name", "n_in"), (stats.fan(self.nodes, self.edges, False), "fan_out", "name", "n_out"), (stats.hot_files(self.nodes, self.edges), "hot_files", "file_path", "n_edges")):
            out = out.unionByName(part(df, name, key, n))
        return out

    def stats(self) -> DataFrame:
        return stats.totals(self.nodes, self.edges)

    def visualize(self, target: str | None = None) -> DataFrame:
        """Diagram lines of file dependencies, around a file if one is named."""
        f = lookup.file_edges(self.nodes, self.edges)
        if target and (found := lookup.resolve_file(self.nodes, target).first()):
            near = traverse.file_neighbourhood(f, found["file_path"], 2).select("file_path")
            f = f.join(near.withColumnRenamed("file_path", "source_file"), "source_file", "left_semi").join(near.withColumnRenamed("file_path", "target_file"), "target_file", "left_semi")
        return context.diagram_edges(f)

    def commands(self) -> dict[str, Callable[..., DataFrame]]:
        names = "callers callees deps rdeps file entity impact dead cycles path search exports summary stats visualize".split()
        return {n: getattr(self, n) for n in names}

    def ask(self, question: str) -> DataFrame | None:
        """The answer to a plain-English question; None if it is none that the router knows."""
        found = router.ask_one(self.nodes.sparkSession, router.route_questions, question)
        return self.commands()[found[0]](*found[1]) if found else None

    def handle(self, request: dict) -> dict:
        """One request of a client: {command, args} or {question}; rows are limited to ``limit``."""
        try:
            if "question" in request:
                df = self.ask(request["question"])
            else:
                df = self.commands()[request["command"]](*request.get("args", []))
        except (KeyError, TypeError) as e:
            return {"ok": False, "error": str(e)}
        if df is None:
            return {"ok": False, "error": "no command matches"}
        return {"ok": True, "rows": [r.asDict(recursive=True) for r in df.limit(int(request.get("limit", 100))).collect()]}

    @staticmethod
    def render(df: DataFrame, limit: int = 50, most: int = 2000) -> str:
        """The first rows as text, cut to ``most`` characters."""
        rows = df.limit(limit).collect()
        text = "\n".join("  ".join("" if v is None else str(v) for v in r) for r in rows) or "nothing found"
        return text if len(text) <= most else text[: most - 4] + " ..."
