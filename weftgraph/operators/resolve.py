"""Names to definitions: module index, imports, ranked targets, inherited methods.

Exact and suffix matches share the last component of the dotted name, so that every candidate is
found by an equi-join on it; ranks and ties are then decided by one window for each reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .traverse import ancestors


def module_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, file_path, ord): every dotted suffix of each file's module path."""
    module = F.btrim(F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/+", "/"), F.lit("/"))
    f = files.select("file_path", "ord", module.alias("module")).where("module <> ''")
    f = f.select("file_path", "ord", "module", F.explode(F.expr("sequence(1, length(module) - length(replace(module, '/', '')) + 1)")).alias("n"))
    return f.select("file_path", "ord", F.expr("translate(substring_index(module, '/', -n), '/', '.')").alias("suffix"))


def module_index(files: DataFrame) -> DataFrame:
    """(suffix, file_path): the first file of each suffix, by ``ord``."""
    return module_suffixes(files).groupBy("suffix").agg(F.min_by("file_path", F.struct("ord", "file_path")).alias("file_path"))


def module_collisions(files: DataFrame) -> DataFrame:
    """(suffix, n_files) of suffixes that several files have."""
    return module_suffixes(files).groupBy("suffix").agg(F.countDistinct("file_path").alias("n_files")).where("n_files > 1")


def imported_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (file_path, imported): the files that a file's imports lead to."""
    s = nodes.select(F.col("id").alias("source_id"), "file_path")
    t = nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("imported"))
    e = edges.where("edge_type = 'imports'").select("source_id", "target_id")
    return e.join(s, "source_id").join(t, "target_id").where("file_path <> imported").select("file_path", "imported").distinct()


def star_import(imports: DataFrame, exported: DataFrame) -> DataFrame:
    """(file_path, name, from_file, confidence, via_star): what ``import *`` brings in.

    ``imports`` (file_path, target_file), ``exported`` (file_path, name).
    """
    e = exported.select(F.col("file_path").alias("target_file"), "name")
    return imports.join(e, "target_file").select("file_path", "name", F.col("target_file").alias("from_file"), F.lit("medium").alias("confidence"), F.lit(True).alias("via_star")).distinct()


def reexport_chain(steps: DataFrame, max_hops: int = 5) -> DataFrame:
    """(start, definition, hops): where import steps (at, to, defines) lead, the nearest definition first.

    ``to`` is followed on while it is an import itself (``defines`` false); ties go to the smaller.
    """
    level = steps.select(F.col("at").alias("start"), "to", "defines", F.lit(1).alias("hops"))
    found = []
    nxt = steps.select(F.col("at").alias("to"), F.col("to").alias("far"), F.col("defines").alias("ends"))
    for d in range(1, max_hops + 1):
        found.append(level.where("defines").select("start", F.col("to").alias("definition"), "hops"))
        if d < max_hops:
            level = level.where("NOT defines").join(nxt, "to").select("start", F.col("far").alias("to"), F.col("ends").alias("defines"), F.lit(d + 1).alias("hops")).distinct()
    best = reduce(DataFrame.unionByName, found).groupBy("start").agg(F.min(F.struct("hops", "definition")).alias("x"))
    return best.select("start", "x.definition", "x.hops")


RANKS = {3: "high", 4: "medium", 5: "medium", 6: "medium", 7: "low", 8: "low"}
CASCADE = {1: "high", 2: "high"} | RANKS | {9: "low", 11: "low"}


def confidence_of(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == k, v) for k, v in CASCADE.items()])


def resolve_targets(references: DataFrame, nodes: DataFrame, imported: DataFrame, stop_names: list[str] = ()) -> DataFrame:
    """The target of each reference (ref_id, name, file_path, kind), or null.

    Candidates are nodes of the kind whose name is the reference's or ends with ``.name``: exact in an
    imported file, exact elsewhere by shared path, exact in the same file, then the same three by
    suffix. Elsewhere ties go to the first node by ``ord``, in imported and own files to the last. A
    test file's node is no candidate elsewhere unless the reference is in a test file as well.
    """
    # references that a file repeats are resolved once
    r = references.select("file_path", "name", "kind").distinct().withColumn("last", N.bare(F.col("name")))
    if stop_names:
        r = r.where(~F.col("name").isin(*stop_names))
    n = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("type").alias("kind"), F.col("file_path").alias("target_file"), "ord", N.bare(F.col("name")).alias("last"))
    c = r.join(n, ["last", "kind"]).where("target_name = name OR endswith(target_name, concat('.', name))")
    i = imported.select("file_path", F.col("imported").alias("target_file"), F.lit(True).alias("known"))
    c = c.join(i, ["file_path", "target_file"], "left")
    exact, own = F.col("target_name") == F.col("name"), F.col("target_file") == F.col("file_path")
    known = F.coalesce("known", F.lit(False))
    c = c.withColumn("rank", F.when(own, F.when(exact, 5).otherwise(8)).when(known, F.when(exact, 3).otherwise(6)).otherwise(F.when(exact, 4).otherwise(7)))
    barred = F.col("rank").isin(4, 7) & N.is_test_file(F.col("target_file")) & ~N.is_test_file(F.col("file_path"))
    c = c.where(~barred).withColumn("score", F.when(F.col("rank").isin(4, 7), N.shared_components(F.col("file_path"), F.col("target_file"))).otherwise(0))
    tie = F.when(F.col("rank").isin(4, 7), F.col("ord")).otherwise(-F.col("ord"))
    # a minimum for each reference: aggregated before the shuffle, so that a common name is no group
    order = F.struct("rank", (-F.col("score")).alias("far"), tie.alias("tie"), "target_id")
    best = c.groupBy("file_path", "name", "kind").agg(F.min(order).alias("x"), F.count("*").alias("n_candidates"))
    confidence = F.coalesce(*[F.when(F.col("x.rank") == k, v) for k, v in RANKS.items()])
    best = best.select("file_path", "name", "kind", F.col("x.target_id").alias("target_id"), F.col("x.rank").alias("rank"), confidence.alias("confidence"), "n_candidates")
    out = references.join(best, ["file_path", "name", "kind"], "left")
    return out.select(*references.columns, "target_id", "rank", "confidence", "n_candidates")


def _split(r: DataFrame, stop_names: list[str]) -> DataFrame:
    """Of ``r`` the dotted names, as receiver and method."""
    dotted = r.where("instr(name, '.') > 0").select("file_path", "name", "kind", F.substring_index("name", ".", 1).alias("receiver"), F.expr("substring(name, instr(name, '.') + 1)").alias("method"))
    return dotted.where(~F.col("receiver").isin(*stop_names)) if stop_names else dotted


def _candidates(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("type").alias("kind"), F.col("file_path").alias("target_file"), "ord", N.bare(F.col("name")).alias("last"))


def nearest(r: DataFrame, nodes: DataFrame, receivers: DataFrame, index: DataFrame, stop_names: list[str] = ()) -> DataFrame:
    """Ranks 1 to 8 of ``resolve_cascade``: (file_path, name, kind, x) of those found, x with rank, target_id, target and target_file.

    ``r`` has distinct (file_path, name, kind) and ``known``, the files that its file imports;
    ``receivers`` (file_path, receiver, target_file) says where the names that a file imports come from.
    """
    defined = _candidates(nodes)
    # both ranks want a member of one file: that of a class of the receiver's name, or the receiver's own
    dotted = _split(r, stop_names)
    classes = nodes.where("type = 'class'").select(F.col("name").alias("receiver"), F.col("file_path").alias("target_file"), F.col("ord").alias("first"))
    one = dotted.where(F.col("receiver").rlike("^[A-Z]")).join(classes, "receiver").withColumn("rank", F.lit(1))
    two = dotted.join(receivers, ["file_path", "receiver"], "left").join(index.select(F.col("suffix").alias("receiver"), F.col("file_path").alias("by_module")), "receiver", "left")
    two = two.withColumn("target_file", F.coalesce("target_file", "by_module")).where("target_file IS NOT NULL").withColumn("first", F.lit(0).cast("bigint")).withColumn("rank", F.lit(2)).select(*one.columns)
    member = one.unionByName(two).withColumn("last", N.bare(F.col("method"))).join(defined, ["target_file", "kind", "last"])
    member = member.where("target = name OR target = method OR endswith(target, concat('.', method))")
    order = lambda rank, first, then: F.struct(rank.alias("rank"), first.cast("bigint").alias("first"), then.cast("bigint").alias("then"), "target_id", "target", "target_file").alias("x")
    member = member.select("file_path", "name", "kind", order(F.col("rank"), F.col("first"), F.col("ord")))

    c = r.withColumn("last", N.bare(F.col("name"))).join(defined, ["last", "kind"]).where("target = name OR endswith(target, concat('.', name))")
    exact, own = F.col("target") == F.col("name"), F.col("target_file") == F.col("file_path")
    known = F.coalesce(F.array_contains("known", F.col("target_file")), F.lit(False))
    c = c.withColumn("rank", F.when(own, F.when(exact, 5).otherwise(8)).when(known, F.when(exact, 3).otherwise(6)).otherwise(F.when(exact, 4).otherwise(7)))
    far = F.col("rank").isin(4, 7)
    c = c.where(~(far & N.is_test_file(F.col("target_file")) & ~N.is_test_file(F.col("file_path"))))
    score = F.when(far, N.shared_components(F.col("file_path"), F.col("target_file"))).otherwise(0)
    ranked = c.select("file_path", "name", "kind", order(F.col("rank"), -score, F.when(far, F.col("ord")).otherwise(-F.col("ord"))))
    # a minimum for each reference: aggregated before the shuffle, so that a common name is no group
    return member.unionByName(ranked).groupBy("file_path", "name", "kind").agg(F.min("x").alias("x"))


def inherited(r: DataFrame, nodes: DataFrame, inherits: DataFrame, stop_names: list[str] = ()) -> DataFrame:
    """Rank 9 of ``resolve_cascade`` for ``r`` (file_path, name, kind): (file_path, name, kind, target_id)."""
    up = inherits.select("source_id", "target_id", F.lit("inherits").alias("edge_type"))
    above = _split(r, stop_names).where("kind = 'function'").select(F.struct("file_path", "name", "kind").alias("ref_id"), F.expr("substring(name, 1, length(name) - instr(reverse(name), '.'))").alias("class_name"), N.bare(F.col("name")).alias("method"))
    return inherited_method(above, nodes, up).select("ref_id.*", "target_id")


def anywhere(r: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rank 11 of ``resolve_cascade``: (file_path, name, kind, x) of ``r``, x with target_id, target and target_file."""
    test = N.is_test_file(F.col("file_path"))
    # only nodes of a name that is looked for; aggregated before the join, a row a name
    every = nodes.select("name", "type", "file_path", "ord", "id").join(r.select("name").distinct(), "name", "left_semi")
    node = (F.col("ord").alias("ord"), F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("file_path").alias("target_file"))
    late = (F.col("type") == "import").alias("late")
    # a test's own references take tests as they come
    every = every.groupBy("name").agg(F.min(F.struct(late, test.alias("test"), *node)).alias("a"), F.min(F.struct(late, *node)).alias("b"))
    pick = lambda c: F.struct(f"{c}.target_id", f"{c}.target", f"{c}.target_file")
    return r.join(every, "name").select("file_path", "name", "kind", F.when(test, pick("b")).otherwise(pick("a")).alias("x"))


def receiver_files(nodes: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """(file_path, receiver, target_file): where the names that a file imports come from.

    By the target of the import, else by the module that it states; the first import of a name counts.
    """
    i = nodes.where("type = 'import'").select("id", "file_path", F.col("name").alias("receiver"), "ord", F.expr("get(imports, 0).module").alias("suffix"))
    t = imports.join(nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("by_edge"), F.col("ord").alias("target_ord")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min_by("by_edge", F.struct("target_ord", "by_edge")).alias("by_edge"))
    i = i.join(t, "id", "left").join(index.select("suffix", F.col("file_path").alias("by_module")), "suffix", "left").withColumn("target_file", F.coalesce("by_edge", "by_module"))
    return i.where("target_file IS NOT NULL").groupBy("file_path", "receiver").agg(F.min_by("target_file", "ord").alias("target_file"))


def resolve_cascade(references: DataFrame, nodes: DataFrame, imports: DataFrame, inherits: DataFrame | None, index: DataFrame, imported: DataFrame, stop_names: list[str] = ()) -> DataFrame:
    """``references`` (ref_id, name, file_path, kind) with target_id, rank and confidence, null where nothing is found.

    Ranks, the smallest wins: 0 a stop name is nothing; 1 ``Class.method`` in the file of a class of
    that name; 2 ``receiver.method`` in the file that the receiver is imported from, or that is a
    module of that name; 3 to 8 as ``resolve_targets``; 9 the method of an ancestor; 11 any node of
    the name, whatever its type (definitions before imports, then those outside tests, then the first).
    ``imports`` and ``inherits`` (source_id, target_id; None: no rank 9) are edges, ``index`` (suffix,
    file_path) modules.
    """
    r = references.select("file_path", "name", "kind").distinct()
    if stop_names:
        r = r.where(~F.col("name").isin(*stop_names))
    defined = nodes.where("type <> 'import'")
    known = imported.groupBy("file_path").agg(F.collect_set("imported").alias("known"))
    flat = lambda df, rank: df.select("file_path", "name", "kind", rank.alias("rank"), F.col("x.target_id").alias("target_id"))
    found = [flat(nearest(r.join(known, "file_path", "left"), defined, receiver_files(nodes, imports, index), index, stop_names), F.col("x.rank")), flat(anywhere(r, nodes), F.lit(11))]
    if inherits is not None:
        found.append(inherited(r, nodes, inherits, stop_names).select("file_path", "name", "kind", F.lit(9).alias("rank"), "target_id"))
    found = reduce(DataFrame.unionByName, found).groupBy("file_path", "name", "kind").agg(F.min(F.struct("rank", "target_id")).alias("x"))
    confidence = confidence_of(F.col("x.rank"))
    found = found.select("file_path", "name", "kind", "x.target_id", "x.rank", confidence.alias("confidence"))
    return references.join(found, ["file_path", "name", "kind"], "left").select(*references.columns, "target_id", "rank", "confidence")


def inherited_method(references: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(ref_id, target_id, depth): ``Class.method`` found in the nearest ancestor that has the method.

    ``references`` (ref_id, class_name, method); ties go to the smaller id.
    """
    classes = nodes.where("type = 'class'").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    up = ancestors(edges, max_depth).select(F.col("id").alias("class_id"), "ancestor", "depth")
    parents = nodes.where("type = 'class'").select(F.col("id").alias("ancestor"), F.col("name").alias("parent"))
    methods = nodes.where("type = 'function'").select(F.col("id").alias("target_id"), "name")
    r = references.join(classes, "class_name").join(up, "class_id").join(parents, "ancestor").withColumn("name", F.concat_ws(".", "parent", "method"))
    best = r.join(methods, "name").groupBy("ref_id").agg(F.min(F.struct("depth", "target_id")).alias("x"))
    return best.select("ref_id", "x.target_id", "x.depth")
