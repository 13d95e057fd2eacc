"""Cycles among files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def file_pairs(file_edges: DataFrame, include_tests: bool = True) -> DataFrame:
    """Distinct (a, b): file a refers to file b."""
    e = file_edges.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).distinct()
    return e if include_tests else e.where(~N.is_test_file(F.col("a")) & ~N.is_test_file(F.col("b")))


def mutual_files(file_edges: DataFrame) -> DataFrame:
    """(a, b), a < b: files that refer to each other."""
    p = file_pairs(file_edges).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") < F.col("b")).alias("up"))
    both = p.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n = 2")
    return both.select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def cyclic_files(file_edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(file_path): files on a cycle of any length.

    Files that nothing leads to, or that lead nowhere, are peeled off until none is left. Of the rest
    each takes the smallest file that leads to it for its label; what leads back to that file within
    the label is a strongly connected component with it. Components go, and what is left is peeled
    again. Tables have at most a row a file or pair; no pairs of files far apart are made.
    """
    from ..session import shared_table

    e = shared_table(file_pairs(file_edges).where("a <> b"), "pairs")
    found = []
    for _ in range(max_rounds):
        e = _peeled(e, max_rounds)
        if e.isEmpty():
            break
        # the smallest file that leads to each: a component has one label, and a label's own file is a pivot
        label = shared_table(e.select(F.explode(F.array("a", "b")).alias("file_path")).distinct().withColumn("label", F.col("file_path")), "label")
        while True:
            pushed = e.join(label.withColumnRenamed("file_path", "a"), "a").groupBy(F.col("b").alias("file_path")).agg(F.min("label").alias("from"))
            new = label.join(pushed, "file_path", "left").select("file_path", F.least("label", F.coalesce("from", "label")).alias("label"), (F.col("from") < F.col("label")).alias("moved"))
            new = shared_table(new, "label")
            label = new.select("file_path", "label")
            if new.where("moved").isEmpty():
                break
        # what leads back to the pivot within its label lies on a cycle with it
        a, b = (label.select(F.col("file_path").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        within = shared_table(e.join(a, "a").join(b, "b").where("label_a = label_b").select("a", "b"), "within")
        frontier = back = label.where("file_path = label").select("file_path")
        while True:
            step = within.join(frontier.withColumnRenamed("file_path", "b"), "b", "left_semi").select(F.col("a").alias("file_path")).distinct()
            frontier = shared_table(step.join(back, "file_path", "left_anti"), "back")
            if frontier.isEmpty():
                break
            back = back.unionByName(frontier)
        # a pivot alone is on no cycle of its own label
        sizes = back.join(label, "file_path").groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
        found.append(shared_table(back.join(label, "file_path").join(sizes, "label", "left_semi").select("file_path"), "cyclic"))
        done = back.withColumnRenamed("file_path", "x")
        e = shared_table(e.join(done, e["a"] == done["x"], "left_anti").join(done, e["b"] == done["x"], "left_anti"), "pairs")
    else:
        raise RuntimeError("cyclic files did not settle")
    out = found[0] if found else e.select(F.col("a").alias("file_path"))
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _peeled(e: DataFrame, max_rounds: int) -> DataFrame:
    """Pairs less those at whose end nothing leads on, over and over."""
    from ..session import shared_table

    n = e.count()
    for _ in range(max_rounds):
        heads, tails = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
        e = shared_table(e.join(heads, "a", "left_semi").join(tails, "b", "left_semi"), "pairs")
        left = e.count()
        if left == n:
            break
        n = left
    return e


def minimal_cycles(file_edges: DataFrame, include_tests: bool = False, max_edges: int = 2_000_000) -> DataFrame:
    """(cycle): file cycles as arrays, the first file repeated at the end.

    Cycles are those that a depth-first search in sorted order closes; each starts at its smallest
    file, and one that holds all files of a smaller one is dropped. Only files on cycles go to the
    search, which one task runs: file graphs are small, and beyond ``max_edges`` it refuses.
    """
    pairs = file_pairs(file_edges, include_tests)
    on = cyclic_files(file_edges)
    core = pairs.join(on.withColumnRenamed("file_path", "a"), "a", "left_semi").join(on.withColumnRenamed("file_path", "b"), "b", "left_semi")
    if (n := core.count()) > max_edges:
        raise ValueError(f"{n} file edges on cycles; use mutual_files or cyclic_files at this size")

    def search(pdf):
        import pandas as pd

        return pd.DataFrame({"cycle": _close(sorted(zip(pdf["a"], pdf["b"], strict=True)))})

    from ..session import on_workers

    on_workers(file_edges.sparkSession)
    return core.groupBy(F.lit(1).alias("one")).applyInPandas(search, "cycle array<string>")


def _close(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles that back edges close; an explicit stack, so that depth has no limit."""
    to: dict[str, list[str]] = {}
    for a, b in pairs:
        to.setdefault(a, []).append(b)
    done, found = set(), {}
    for root in sorted(to):
        if root in done:
            continue
        trail, place, stack = [root], {root: 0}, [iter(to[root])]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                gone = trail.pop()
                del place[gone]
                done.add(gone)
            elif nxt in place:
                ring = trail[place[nxt] :]
                k = ring.index(min(ring))
                ring = ring[k:] + ring[:k]
                found[tuple(ring)] = frozenset(ring)
            elif nxt not in done:
                place[nxt] = len(trail)
                trail.append(nxt)
                stack.append(iter(to.get(nxt, ())))
    keep: list[tuple] = []
    for ring in sorted(found, key=lambda r: (len(r), r)):
        if not any(found[k] < found[ring] for k in keep):
            keep.append(ring)
    return [[*r, r[0]] for r in sorted(keep)]
