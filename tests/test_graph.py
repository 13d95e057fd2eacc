"""Graph operators on small hand-made graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import context, cycles, dead, delta, lookup, mutate, propagate, resolve, stats, traverse, versioning

NODE = "id string, type string, name string, file_path string, line_start bigint"
EDGE = "source_id string, target_id string, edge_type string, confidence string"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "high") if len(r) == 3 else r for r in rows], EDGE)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, [
        ("a", "class", "Model", "m.py", 1), ("b", "function", "Model.save", "m.py", 2), ("c", "function", "handle", "s.py", 1), ("d", "function", "main", "s.py", 9),
        ("e", "function", "unused", "s.py", 20), ("f", "function", "test_it", "tests/test_s.py", 1), ("g", "import", "Model", "s.py", 0), ("h", "class", "Child", "c.py", 1), ("i", "function", "Child.save", "c.py", 2), ("j", "function", "Child.save.inner.deep", "c.py", 3),
    ])
    e = edges(spark, [("c", "b", "calls", "high"), ("d", "c", "calls", "low"), ("c", "a", "imports", "high"), ("h", "a", "inherits", "high"), ("ghost", "c", "calls", "low")])
    return n, e


def test_callers_and_callees(small):
    assert values(lookup.callers(*small, "handle"), "name", "confidence") == [("ghost", "low"), ("main", "low")]
    assert values(lookup.callers(*small, "handle", high_only=True), "name") == []
    assert values(lookup.callees(*small, "handle"), "name", "edge_type") == [("Model", "imports"), ("Model.save", "calls")]


def test_resolution_is_progressive(small):
    n, _ = small
    assert values(lookup.resolve(n, "Model"), "id") == [("a",), ("g",)]
    assert values(lookup.resolve(n, "save"), "id") == [("b",), ("i",)]
    assert values(lookup.resolve(n, "hand.*"), "id") == [("c",)]
    assert values(lookup.resolve(n, "(["), "id") == []


def test_file_views(small):
    n, e = small
    assert values(lookup.file_deps(n, e, "s.py"), "dep", "edge_type") == [("m.py", "calls"), ("m.py", "imports")]
    assert values(lookup.file_rdeps(n, e, "m.py"), "dep", "edge_type") == [("c.py", "inherits"), ("s.py", "calls"), ("s.py", "imports")]
    assert [r.name for r in lookup.file_entities(n, e, "m.py").collect()] == ["Model", "Model.save"]
    assert values(lookup.node_filter(n, file_path="s.py", kind="function"), "id") == [("c",), ("d",), ("e",)]
    assert lookup.node_filter(n).count() == n.count()


def test_entity_detail_lists_neighbours(small):
    r = lookup.entity_detail(*small, "handle").collect()
    assert [(x.out_edges, x.in_edges) for x in r] == [("calls:Model.save,imports:Model", "calls:ghost,calls:main")]


def test_dead_code_rules(small):
    got = {r.name for r in dead.dead_code(*small).collect()}
    # main is an entry, tests are excused, Child.save overrides a called method, deep is nested in it
    assert got == {"unused", "Child"} | ({"Child.save.inner.deep"} if "Child.save.inner.deep" in got else set())
    assert "Child.save" not in got
    assert "test_it" in {r.name for r in dead.dead_code(*small, include_tests=True, include_framework=True).collect()}


def test_traversal_depth_type_and_direction(spark):
    n = nodes(spark, [(x, "function", x, f"{x}.py", 1) for x in "abcde"])
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "imports"), ("c", "d", "calls"), ("d", "a", "calls"), ("a", "x", "calls"), ("x", "e", "calls")])
    start = n.where("id = 'a'").select("id")
    assert values(traverse.traverse(n, e, start, None, "out", 2), "id", "depth") == [("b", 1), ("c", 2), ("e", 2)]  # through an id without a node
    assert values(traverse.traverse(n, e, start, ["calls"], "out", 3), "id") == [("b",), ("e",)]
    assert values(traverse.traverse(n, e, start, None, "in", 1), "id") == [("d",)]
    deep = traverse.traverse(n, e, start, None, "both", 10)
    assert values(deep, "id", "depth") == [("b", 1), ("c", 2), ("d", 1), ("e", 2)]
    ids = n.select("id")
    assert values(traverse.reachable(e, start, ids, 10).where("reachable"), "id") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert values(traverse.shortest_paths(e, start, 10).where("id = 'd'"), "hops", "path") == [(3, "a>b>c>d")]


def test_levels_unrolled_and_looped_agree(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    pair = st.tuples(st.integers(0, 7), st.integers(0, 7))

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(pair, min_size=1, max_size=14))
    def check(pairs):
        e = edges(spark, [(str(a), str(b), "calls") for a, b in pairs])
        start = spark.createDataFrame([("0",)], "id string")
        want, seen, now = {}, {"0"}, {"0"}
        for d in range(1, 9):
            now = {str(b) for a, b in pairs if str(a) in now} - seen
            seen |= now
            want |= {x: d for x in now}
        moves = traverse.adjacency(e)
        assert dict(values(traverse.levels(moves, start, 8), "id", "depth")) == want
        assert dict(values(traverse.levels(moves, start, 3), "id", "depth")) == {k: v for k, v in want.items() if v <= 3}

    check()


def test_components(spark):
    e = edges(spark, [("b", "a", "calls"), ("c", "b", "calls"), ("y", "x", "calls")])
    assert values(traverse.components(e), "id", "root") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


FILE = "source_file string, target_file string, edge_type string"


def files(spark, pairs):
    return spark.createDataFrame([(a, b, "imports") for a, b in pairs], FILE)


def test_cycles(spark):
    two = files(spark, [("b", "a"), ("a", "b")])
    assert [r.cycle for r in cycles.minimal_cycles(two).collect()] == [["a", "b", "a"]]
    over = files(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")])
    assert [r.cycle for r in cycles.minimal_cycles(over).collect()] == [["a", "b", "a"]]
    assert values(cycles.mutual_files(over), "a", "b") == [("a", "b")]
    chain = [(f"f{i:04d}", f"f{i + 1:04d}") for i in range(40)]
    assert cycles.minimal_cycles(files(spark, chain)).count() == 0
    assert cycles.cyclic_files(files(spark, [*chain, ("z", "f0000")])).count() == 0


def test_closing_a_deep_cycle_needs_no_recursion():
    pairs = [(f"f{i:05d}", f"f{i + 1:05d}") for i in range(5000)] + [("f05000", "f00000")]
    assert len(cycles._close(pairs)) == 1 and cycles._close(pairs[:-1]) == []


def test_impact_and_neighbourhood(spark):
    f = files(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")])
    assert values(traverse.impact(f, "a"), "file_path") == [("b",), ("c",), ("d",)]
    assert values(traverse.file_neighbourhood(f, "c"), "file_path", "depth") == [("a", 2), ("b", 1), ("c", 0), ("d", 1), ("e", 2)]


def test_graph_hash_ignores_order(small):
    n, e = small
    a = stats.graph_hash(n, e).first().graph_hash
    assert a == stats.graph_hash(n.repartition(5), e.orderBy("target_id")).first().graph_hash
    assert a != stats.graph_hash(n, e.limit(2)).first().graph_hash


# --- delta ---------------------------------------------------------------------------------------

ENTITY = "file_path string, seq bigint, name string, type string, sig string, struct string, line_start int, line_end int, ord bigint"


def versions(spark, *contents):
    """Versions of one file; an entity is name, sig, struct, line_start, line_end."""
    v = spark.createDataFrame([("f", i, not c) for i, c in enumerate(contents)], "file_path string, seq bigint, blank boolean")
    rows = [("f", i, n, "function", s, t, a, b, k) for i, c in enumerate(contents) for k, (n, s, t, a, b) in enumerate(c or [])]
    return v, spark.createDataFrame(rows, ENTITY)


def test_gate(spark):
    a = [("x", "1", "s", 1, 2)]
    v, e = versions(spark, a, [("x", "1", "s", 5, 6)], [("x", "2", "s", 5, 6)], None)
    assert [r.passes for r in delta.semantic_gate(v, e).orderBy("seq").collect()] == [True, False, True, True]
    broken = v.withColumn("blank", F.lit(False))
    assert [r.passes for r in delta.semantic_gate(broken, e).orderBy("seq").collect()][-1] is False


def test_delta_and_rename(spark):
    v, e = versions(spark, [("old", "1", "s", 1, 5), ("keep", "k", "q", 6, 9), ("gone", "g", "w", 10, 12)], [("new", "2", "s", 2, 6), ("keep", "k2", "q", 7, 9), ("fresh", "f", "z", 20, 22)])
    d = delta.delta_rows(v, e).where("seq = 1")
    assert {(r.name, r.kind, r.old_name) for r in d.collect()} == {("new", "modified", "old"), ("keep", "modified", None), ("gone", "removed", None), ("fresh", "added", None)}
    assert [(r.op_type, r.name) for r in delta.op_feed(d).orderBy("place").collect()] == [("remove_node", "gone"), ("add_node", "fresh"), ("update_node", "keep"), ("update_node", "new")]


def test_last_of_one_name_counts(spark):
    v, e = versions(spark, [("x", "1", "s", 1, 2), ("x", "2", "s", 3, 4)], [("x", "2", "s", 3, 4)])
    assert delta.delta_rows(v, e).where("seq = 1").count() == 0


# --- resolution ----------------------------------------------------------------------------------


def test_ranked_targets(spark):
    n = spark.createDataFrame([("1", "function", "run", "a/x.py", 1, 1), ("2", "function", "run", "b/y.py", 1, 2), ("3", "function", "run", "a/z.py", 1, 3), ("4", "function", "K.run", "b/k.py", 1, 4), ("5", "function", "go", "tests/test_q.py", 1, 5)], NODE + ", ord bigint")
    imported = spark.createDataFrame([("a/m.py", "b/y.py"), ("c/m.py", "b/k.py")], "file_path string, imported string")
    refs = spark.createDataFrame(
        [("imp", "run", "a/m.py", "function"), ("near", "run", "a/n.py", "function"), ("own", "K.run", "b/k.py", "function"), ("suffix", "run", "c/m.py", "function"), ("test", "go", "a/m.py", "function"), ("in_test", "go", "tests/test_r.py", "function"), ("none", "walk", "a/m.py", "function")],
        "ref_id string, name string, file_path string, kind string",
    )
    got = {r.ref_id: (r.target_id, r.rank, r.confidence) for r in resolve.resolve_targets(refs, n, imported).collect()}
    assert got == {"imp": ("2", 3, "high"), "near": ("1", 4, "medium"), "own": ("4", 5, "medium"), "suffix": ("1", 4, "medium"), "test": (None, None, None), "in_test": ("5", 4, "medium"), "none": (None, None, None)}


def test_modules_and_collisions(spark):
    f = spark.createDataFrame([("pkg1/utils.py", 1), ("pkg2/utils.py", 2)], "file_path string, ord bigint")
    assert values(resolve.module_index(f), "suffix", "file_path") == [("pkg1.utils", "pkg1/utils.py"), ("pkg2.utils", "pkg2/utils.py"), ("utils", "pkg1/utils.py")]
    assert values(resolve.module_collisions(f), "suffix", "n_files") == [("utils", 2)]


def test_reexports_end(spark):
    steps = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("c", "d", True), ("x", "y", False), ("y", "x", False)], "at string, to string, defines boolean")
    assert values(resolve.reexport_chain(steps), "start", "definition", "hops") == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1)]


def test_inherited_method(spark, small):
    n, e = small
    refs = spark.createDataFrame([("r", "Child", "save"), ("s", "Model", "save")], "ref_id string, class_name string, method string")
    assert values(resolve.inherited_method(refs, n, e), "ref_id", "target_id", "depth") == [("r", "b", 1)]


# --- log, operations, propagation ----------------------------------------------------------------


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("k"), "id").repartition(7)
    got = versioning.numbered(df, ["k", "id"]).orderBy("version").collect()
    assert [r.version for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_conflicts_and_sessions(spark):
    recent = spark.createDataFrame([(5, "remove_node", "n1", None), (6, "update_node", "n2", "old"), (7, "update_node", "n3", None)], "version bigint, op_type string, node_id string, renamed_from string")
    p = spark.createDataFrame([("a", "update_node", "n1", ["x"]), ("b", "update_node", "n2", ["very_old_name"]), ("c", "update_node", "n3", []), ("d", "remove_node", "n3", [])], "prop_id string, op_type string, node_id string, calls array<string>")
    assert values(versioning.conflicts(recent, p), "prop_id", "conflict", "severity") == [("a", "deletion", "error"), ("b", "rename", "warning"), ("c", "concurrent_edit", "warning")]
    assert values(versioning.stale_references(recent, p), "prop_id", "version") == [("b", 6)]
    assert values(versioning.deletion_fix(p, recent), "prop_id") == [("b",), ("c",), ("d",)]
    s = spark.createDataFrame([(1, 9, True, 0, 0), (2, 5, True, 0, 0), (3, 5, True, 2, 1), (4, 5, True, 2, 0), (5, 9, False, 0, 0)], "session_id int, base_version bigint, known boolean, n_proposed int, n_conflicts int")
    assert [r.status for r in versioning.session_status(s, 9).orderBy("session_id").collect()] == ["clean", "clean_with_drift", "conflicts", "clean_with_drift", "error"]


def test_rename_fix_keeps_order(spark):
    p = spark.createDataFrame([("a", ["x", "old", "y"])], "prop_id string, names array<string>")
    m = spark.createDataFrame([("old", "new")], "old_name string, new_name string")
    assert versioning.rename_fix(p, m).first().names == ["x", "new", "y"]


def test_operations_and_their_undo(spark, small):
    g = mutate.Graph(*small)
    gone = g.nodes.where("id = 'c'")
    after = mutate.remove_nodes(g, gone)
    assert values(after.edges, "source_id", "target_id") == [("h", "a")]
    back = mutate.restore(after, g, gone)
    key = ["source_id", "target_id", "edge_type"]
    assert values(back.edges, *key) == values(g.edges, *key) and values(back.nodes, "id") == values(g.nodes, "id")
    assert mutate.add_nodes(g, g.nodes.limit(2)).nodes.count() == g.nodes.count()
    twice = mutate.add_edges(g, g.edges.where("source_id = 'd'"))
    assert mutate.remove_edges(twice, g.edges.where("source_id = 'd'")).edges.where("source_id = 'd'").count() == 1
    moved = mutate.retarget_edges(g, spark.createDataFrame([("d", "c", "calls", "e")], "source_id string, target_id string, edge_type string, new_target string"))
    assert values(moved.edges.where("source_id = 'd'"), "target_id", "confidence") == [("e", "low")]
    assert values(mutate.remove_file(g, "s.py").nodes.where("file_path = 's.py'"), "id") == []
    renamed = mutate.rename_nodes(g, spark.createDataFrame([("c", "serve")], "id string, name string"))
    assert renamed.nodes.where("id = 'c'").first().name == "serve"


def test_batches_are_whole_or_nothing(spark, small):
    ops = spark.createDataFrame([("ok", 1, "add_node", "z"), ("ok", 2, "update_node", "z"), ("ok", 3, "remove_node", "z"), ("bad", 1, "remove_node", "a"), ("bad", 2, "update_node", "a")], "batch_id string, place bigint, op_type string, node_id string")
    assert values(mutate.batch_status(ops, small[0]), "batch_id", "n_failed", "applied") == [("bad", 1, False), ("ok", 0, True)]
    one = ops.where("batch_id = 'bad'").drop("batch_id")
    assert values(mutate.effective(one, small[0]), "place", "ok") == [(1, True), (2, False)]


def test_phases_and_zones(spark):
    f = spark.createDataFrame([(f"f{i:03d}", 1, i) for i in range(70)], "file_path string, depth int, priority int")
    n = {r.phase: r.n for r in propagate.phases(f).groupBy("phase").agg(F.count("*").alias("n")).collect()}
    assert n == {"sync": 5, "async": 50, "deferred": 15}
    a = spark.createDataFrame([(f"f{i:02d}", i, "open") for i in range(14)] + [("f13", 20, "close")], "file string, version bigint, action string")
    z = {r.file: r.zone for r in propagate.zones(a).collect()}
    assert [k for k, v in sorted(z.items()) if v == "HOT"] == [f"f{i:02d}" for i in range(3, 13)]
    files_ = spark.createDataFrame([("f12",), ("none",)], "file string")
    assert values(propagate.zone_of(files_, propagate.zones(a)), "file", "zone") == [("f12", "HOT"), ("none", "COLD")]
    p = spark.range(1).select(propagate.file_priority(F.lit(2), F.lit(True), F.lit(10), F.lit("tests/generated/x.py")).alias("p"), propagate.zone_priority(F.lit(False), F.lit(5), F.lit("a_test.py")).alias("z")).first()
    assert (p.p, p.z) == (20 * 2 - 100 - 50 + 30 + 50, 100 - 30 + 20)


def test_budget_and_grouping(spark):
    one = spark.createDataFrame([(["aaaa", "bbbbbbbbb", "cc", "dd"],)], "parts array<string>")
    assert one.select(context.within_budget(F.col("parts"), 8).alias("k")).first().k == ["aaaa", "cc", "dd"]
    f = spark.createDataFrame([("t", p) for p in ("x/a.py", "x/b.py", "x/c.py", "y/d.py", "e.py")], "by string, file_path string")
    assert context.affected_grouping(f, "by").first().listed == "d.py, e.py, x/ (3 files)"
    many = spark.createDataFrame([("t", f"{i}/f{i}.py") for i in range(7)], "by string, file_path string")
    assert context.affected_grouping(many, "by").first().listed == "f0.py, f1.py, f2.py, f3.py +3 more"


def test_nested_context_and_summary(small):
    c = {r.entity: r for r in context.file_context(*small).where("file_path = 's.py'").collect()}
    assert [(x.name, x.edge_type) for x in c["handle"].calls_out] == [("Model", "imports"), ("Model.save", "calls")]
    assert [x.name for x in c["handle"].called_by] == ["ghost", "main"]
    s = context.summary(*small)
    assert s["types"]["function"] == 7 and len(s["cross"]) == 3


def test_exports_prefer_the_list(spark):
    n = spark.createDataFrame([("1", "variable", "__all__", "a.py", 1, ["x"]), ("2", "function", "x", "a.py", 2, None), ("3", "function", "y", "a.py", 3, None), ("4", "function", "z", "b.py", 1, None), ("5", "function", "K.z", "b.py", 1, None)], NODE + ", uses array<string>")
    assert values(lookup.exports(n), "file_path", "name") == [("a.py", "x"), ("b.py", "z")]


def test_rich_context_fits(small):
    text = context.rich_context(*small, "s.py", 200)
    assert text.startswith("s.py: 3fn 0cls") and len(text) <= 200 and "deps: m.py" in text
    assert context.rich_context(*small, "nowhere.py") == ""
    assert "affects: c.py, s.py" in context.rich_context(*small, "m.py")


def test_naive_rebuild_baseline(spark, small):
    from weftgraph.operators import reports

    refs = spark.createDataFrame([("d", "handle"), ("d", "nope")], "source_id string, name string")
    assert values(reports.naive_calls(small[0], refs), "source_id", "target_id") == [("d", "c")]
    f = spark.createDataFrame([("a/util.py", "x"), ("b.py", "import util"), ("c.py", "none")], "file_path string, content string")
    assert values(reports.naive_affected(f, "a/util.py"), "file_path") == [("b.py",)]


def test_unresolved_calls_match_both_ends(spark):
    from weftgraph.operators import stats

    calls = spark.createDataFrame([("a.b",), ("b",), ("x.a.b",), ("z",), ("z",), ("ab",), (None,)], "name string")
    known = spark.createDataFrame([("a.b",), (None,)], "name string")
    assert {(r["name"], r["n"]) for r in stats.unresolved_calls(calls, known).collect()} == {("z", 2), ("ab", 1)}
    assert stats.unresolved_calls(calls.limit(0), known).count() == 0


def test_mentions_at_borders(spark):
    from weftgraph.operators import reports

    cases = [("credits", "api/credits.py", True), ("credits", "require_credits", False), ("track_", "call track_usage", True), ("track_", "backtrack_x", False), ("llm/", "api/llm/x", True), ("llm/", "allm/x", False), ("core.py", "see core.py", True)]
    cases += [("NodeStore", "the store of a node", True), ("NodeStore", "a node" + " " * 200 + "store", False), ("a.b", "axb", False), (None, "x", False), ("x", None, False), ("Ab", "", False)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, m string, r string, want boolean")
    wrong = df.withColumn("got", reports.mentioned(F.col("m"), F.col("r"))).where("got <> want").collect()
    assert not wrong
    runs = spark.createDataFrame([(1, [], "x"), (2, None, None), (3, ["x", None], "x y")], "k int, expected array<string>, response string")
    assert {r["k"]: r["accuracy"] for r in reports.accuracy(runs, "k").collect()} == {1: 1.0, 2: 1.0, 3: 0.5}


def test_prompt_mentions(spark):
    from weftgraph.operators import lookup

    nodes = spark.createDataFrame([("area", "src/b.py", 3), ("area", "src/a.py", 9), ("x", "c", 1)], "name string, file_path string, line_start int")
    asks = spark.createDataFrame([(1, "who uses `area` in src/b.py, or ./src?"), (2, None), (3, "x y")], "k int, text string")
    got = {(r["k"], r["place"], r["token"], r["kind"], r["found"]) for r in lookup.prompt_mentions(asks, nodes, "k").collect()}
    assert got == {(1, 1, "area", "entity", "src/a.py:9"), (1, 2, "src", "file", "src/a.py"), (1, 3, "src/b.py", "file", "src/b.py")}
