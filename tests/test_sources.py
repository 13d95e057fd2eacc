"""Extraction, routing, stores, streams and the engine."""

from __future__ import annotations

import ast
import json
import json.decoder
import typing
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph import extract, router
from weftgraph.engine import Engine
from weftgraph.extract import extract_one, partial, python_ast
from weftgraph.extract.entity import Entity, entity_batch
from weftgraph.functions import names as N
from weftgraph.functions import tokens as T
from weftgraph.operators import resolve
from weftgraph.operators.mutate import Graph
from weftgraph.plans import generated, samples
from weftgraph.session import shared_table
from weftgraph.sources import projects, store
from weftgraph.streaming import changes, keystrokes, windows


def named(path, source=None):
    return {(e.entity_type, e.name): e for e in extract_one(path, source if source is not None else samples.FILES[path])}


def test_python_entities():
    e = named("shop/service.py")
    assert e["class", "Service"].inherits == ["Base"]
    assert e["function", "Service.save"].calls == ["Service.check", "put_order"] or "Service.check" in e["function", "Service.save"].calls
    assert e["function", "Service.save"].params == ["order"] and e["function", "Service.save"].type_refs == ["Order"]
    assert ("function", "Service.check.positive") in e
    assert e["function", "main"].calls[:2] == ["Service", "Service.save"]  # typed by its constructor
    assert e["module_code", "__module__"].calls == ["main"]
    m = named("shop/models.py")
    assert m["variable", "__all__"].uses == ["Order", "total"]
    assert m["class", "Order"].decorators == ["dataclass"]
    assert "json.loads" not in m["function", "Order.price"].calls


def test_python_hashes():
    one = lambda s: extract_one("a.py", s)[0]
    a, b, c = one("def f(x):\n    return x\n"), one("def f(x):  # note\n\n    return x\n"), one("def g(x):\n    return x\n")
    assert a.signature_hash == b.signature_hash != c.signature_hash
    assert a.structure_hash == c.structure_hash
    assert a.signature_hash != one("def f(x):\n    'doc'\n    return x\n").signature_hash
    assert extract_one("a.py", "def f(:\n") == [] and extract_one("a.txt", "x") == []


@pytest.mark.parametrize(
    ("path", "kind", "name", "inherits"),
    [
        ("web/cart.ts", "class", "Cart", ["Base"]), ("web/cart.ts", "class", "Priced", []), ("web/cart.ts", "function", "Cart.add", []), ("web/cart.ts", "function", "render", []), ("web/cart.ts", "variable", "Id", []),
        ("web/util.js", "function", "load", []), ("web/util.js", "class", "Store", ["Base"]), ("core/graph.rs", "class", "Walk", ["Visit", "Send"]), ("core/graph.rs", "function", "Graph.walk", []), ("core/graph.rs", "variable", "LIMIT", []), ("core/graph.rs", "module_code", "tests", []),
        ("native/list.cpp", "class", "app.List", ["Base", "Impl"]), ("native/list.cpp", "function", "app.List.size", []), ("native/list.cpp", "function", "total", []), ("native/list.c", "function", "push", []), ("native/list.c", "variable", "MAX", []), ("native/list.c", "class", "node", []),
        ("app/Main.java", "class", "Main", ["Base"]), ("app/Main.java", "function", "Main.run", []), ("app/Main.java", "function", "Main.Main", []),
    ],
)
def test_declarations(path, kind, name, inherits):
    found = [e for e in extract_one(path, samples.FILES[path]) if (e.entity_type, e.name) == (kind, name)]
    assert found and any(e.inherits == inherits for e in found)


def test_imports_by_language():
    got = {p: {(i["module"], i["name"]) for e in extract_one(p, s) for i in e.imports} for p, s in samples.FILES.items()}
    assert ("./models", "Money") in got["web/cart.ts"] and ("fs", "fs") in got["web/util.js"]
    assert {("std::collections", "HashMap"), ("crate::node", "Node")} <= got["core/graph.rs"]
    assert {(".", "list.h"), ("", "vector"), ("", "std")} == got["native/list.cpp"]
    assert {("java.util", "List"), ("app.Util", "*")} == got["app/Main.java"]


def test_comments_and_strings_hold_no_calls():
    e = named("web/cart.ts")["function", "Cart.add"]
    assert "not" not in e.calls and {"render"} <= set(e.calls)
    assert named("app/Main.java")["class", "Main"].decorators == ["Service"]


def test_table_function(spark):
    f = spark.createDataFrame(list(samples.FILES.items()) + [("x.py", None), ("README", "text")], "file_path string, content string")
    rows = extract.extract_entities(f).collect()
    assert {r.file_path for r in rows} == set(samples.FILES)
    assert len(rows) == sum(len(extract_one(p, s)) for p, s in samples.FILES.items())


def test_own_languages_register(spark):
    from weftgraph.extract.entity import Entity

    extract.register("toy", (".toy",), lambda s: [Entity("function", w, 1, 1, w, w) for w in s.split()])
    try:
        assert [e.name for e in extract_one("a.toy", "p q")] == ["p", "q"]
    finally:
        del extract.REGISTRY["toy"]


def test_partial_parse_and_update():
    r = partial.regions(samples.BROKEN["broken/half.py"])
    assert {n for x in r for n in x["names"]} >= {"good", "bad", "Open", "after"}
    assert all(0 <= x["confidence"] <= 1 for x in r)
    mended = samples.BROKEN["broken/half.py"].replace("def bad(x:", "def bad(x):").replace("return (x\n", "return x\n")
    again = partial.update(r, mended, 6, 7)
    assert any(x["status"] == "VALID" and "bad" in x["names"] for x in again)
    assert all(s["signature_hash"].startswith("shadow:") for s in partial.shadow(samples.BROKEN["broken/half.py"]))


def test_scopes():
    s = python_ast.scopes("class A:\n    def f(self, x=1):\n        y = x\n")
    assert [(x["entity_type"], x["name"], x["scope_chain"]) for x in s] == [("class", "A", []), ("function", "f", ["A"]), ("parameter", "self", ["A", "f"]), ("parameter", "x", ["A", "f"]), ("variable", "y", ["A", "f"])]


QUESTIONS = [
    ("Who calls parse_file?", ("callers", ["parse_file"])), ("what depends on util", ("rdeps", ["util"])), ("dependencies of api.py", ("deps", ["api.py"])), ("circular dependencies", ("cycles", [])), ("path from A to B", ("path", ["A", "B"])),
    ("how is A connected to B", ("path", ["A", "B"])), ("find dead code", ("dead", [])), ("impact of changing validate", ("impact", ["validate"])), ("architecture overview", ("summary", [])), ("make me a sandwich", None), ("describe the Engine", ("entity", ["Engine"])),
    ("who uses the", None), ("exports of core.py?", ("exports", ["core.py?".rstrip("?")])),
]


def _told(spark, classify, texts):
    rows = classify(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, text string"), "text").collect()
    return [(r.command, r.args.split()) if r.command else None for r in sorted(rows, key=lambda r: r.k)]


def test_router(spark):
    assert _told(spark, router.route_questions, [q for q, _ in QUESTIONS]) == [found for _, found in QUESTIONS]
    assert router.ask_one(spark, router.route_questions, "path from A to B") == ("path", ["A", "B"])


def test_classifiers(spark):
    p = ["parse_file(", "from core import x", "class Engine", "MAX_SIZE(", "x("]
    got = {r.pattern: (r.command, r.name) for r in router.classify_greps(spark.createDataFrame([(x,) for x in p], "pattern string")).collect()}
    assert got == dict(zip(p, [("callers", "parse_file"), ("rdeps", "core"), ("entity", "Engine"), (None, None), (None, None)], strict=True))
    asked = ["find all usages of Widget.", "check for orphan functions", "who calls Parser?", "hello there"]
    assert _told(spark, router.classify_explore, asked) == [("callers", ["widget"]), ("dead", []), ("callers", ["Parser"]), None]


def test_keystroke_rules(spark):
    k = T.Keystrokes()
    tier = lambda text: [k.press(c, 0) for c in text][-1]
    assert tier("f(") == T.TOKEN and tier("x)") == T.STATEMENT and tier("if x:") == T.STATEMENT
    assert tier("'a:") == T.BUFFER_ONLY and tier("'") == T.BUFFER_ONLY
    assert tier("a,\n") == T.TOKEN and tier("a\n") == T.STATEMENT
    assert k.press("a", 600) == T.SEMANTIC and k.press("b", 850) == T.STATEMENT and k.press("c", 920) == T.TOKEN
    full = T.Keystrokes()
    assert [full.press("a", 0) for _ in range(1001)][-2:] == [T.TOKEN, T.TOKEN] and full.flush() == "a" * 1000
    keys = spark.createDataFrame([("s", i, c, float(i)) for i, c in enumerate("def f():\n")] + [("t", 0, "(", 0.0)], "session string, seq bigint, ch string, ms double")
    got = [r.tier for r in keystrokes.tiers(keys).where("session = 's'").orderBy("seq").collect()]
    one = T.Keystrokes()
    assert got == [one.press(c, float(i)) for i, c in enumerate("def f():\n")]


def test_keystroke_stream_carries_its_state(spark, tmp_path):
    schema = "session string, seq bigint, ch string, ms double"
    text = "x = f(a,\n b)\ny"
    src = str(tmp_path / "in")
    for lo in (0, 6):
        rows = [("s", i, c, 40.0 * i) for i, c in enumerate(text) if lo <= i < (6 if lo == 0 else 99)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = keystrokes.tier_stream(stream).writeStream.format("memory").queryName("tiers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    one = T.Keystrokes()
    assert [r.tier for r in spark.table("tiers").orderBy("seq").collect()] == [one.press(c, 40.0 * i) for i, c in enumerate(text)]


def test_stable_context(spark):
    s = T.Stabiliser()
    assert s.request(0, 0.8) == (True, 0.8) and s.request(100, 0.8) == (False, 0.4) and s.request(300, 0.8) == (True, 0.8)
    s.invalidate()
    assert s.request(301, 0.8)[0]
    s.keystroke(0)
    s.keystroke(450)
    assert s.window == 450
    df = spark.createDataFrame([("a", 1, 0.0, 0.8), ("a", 2, 100.0, 0.8), ("b", 1, 50.0, 0.6)], "session string, seq bigint, ms double, confidence double")
    assert sorted((r.session, r.seq, r.rebuilt, r.confidence) for r in keystrokes.stable_context(df).collect()) == [("a", 1, True, 0.8), ("a", 2, False, 0.4), ("b", 1, True, 0.6)]


@pytest.mark.parametrize(("token", "sure"), [("", 0.0), ("print", 1.0), ("user_id", 0.95), ("foo_", 0.3), ("x", 0.2), ("a_b", 0.85), ("MAX", 0.9), ("camelCase", 0.85), ("plain", 0.6)])
def test_token_confidence(spark, token, sure):
    assert spark.range(1).select(T.token_confidence(F.lit(token)).alias("c")).first().c == sure


@pytest.mark.parametrize(("path", "is_test"), [("tests/a.py", True), ("src/test_a.py", True), ("a_test.py", True), ("x.spec.ts", True), ("src/FooTest.java", True), ("src/contest.py", False), ("latest/a.py", False)])
def test_test_files(spark, path, is_test):
    assert spark.range(1).select(N.is_test_file(F.lit(path)).alias("t")).first().t is is_test


def test_names(spark):
    r = spark.range(1).select(N.shared_components(F.lit("a/b/c.py"), F.lit("a/b/d.py")).alias("s"), N.bare(F.lit("A.b.c")).alias("b"), N.qualifier(F.lit("A.b.c")).alias("q"), N.diagram_id(F.lit("a/b-c.py d")).alias("d")).first()
    assert (r.s, r.b, r.q, r.d) == (2, "c", "A.b", "a_b_c_py_d")


def test_scan_and_changes(spark, tmp_path):
    for p, text in {"a.py": "x = 1\n", "sub/b.ts": "function f() {}\n", ".git/c.py": "no", "node_modules/d.js": "no", "e.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    now = projects.scan_files(spark, str(tmp_path))
    assert sorted(r.file_path for r in now.collect()) == ["a.py", "sub/b.ts"]
    known = spark.createDataFrame([("a.py", "x = 0\n"), ("gone.py", "y\n"), ("sub/b.ts", "function f() {}\n")], "file_path string, content string")
    assert sorted((r.file_path, r.old_content, r.new_content) for r in projects.changes_since(known, now).collect()) == [("a.py", "x = 0\n", "x = 1\n"), ("gone.py", "y\n", "")]
    assert [r.file_path for r in projects.deleted_files(known, now).collect()] == ["gone.py"]
    assert projects.scan_files(spark, str(tmp_path), max_files=1).count() == 1


@pytest.fixture(scope="module")
def graph(spark):
    f = spark.createDataFrame(list(samples.FILES.items()), "file_path string, content string").withColumn("seq", F.lit(0).cast("bigint"))
    n = changes.nodes_of(changes.entities_of(f))
    from weftgraph.session import shared_table

    n = shared_table(n, "nodes")
    return Graph(n, shared_table(changes.edges_of(n), "edges"))


def test_project_edges(graph):
    n = {r.id: r for r in graph.nodes.collect()}
    got = {(n[r.source_id].name, r.edge_type, n[r.target_id].name) for r in graph.edges.collect()}
    assert {("Service", "inherits", "Base"), ("Service.save", "calls", "Service.check"), ("Service.check", "calls", "total"), ("main", "calls", "Service"), ("Service.save", "uses_type", "Order"), ("total", "imports", "total"), ("Cart.add", "calls", "render")} <= got
    assert not any(a == b for r in graph.edges.collect() for a, b in [(r.source_id, r.target_id)])


def test_store_round_trip(spark, graph, tmp_path):
    at = f"file://{tmp_path}/g"
    with pytest.raises(store.StoreError):
        store.load(spark, at)
    store.save(graph, at)
    back = store.load(spark, at)
    assert back.nodes.count() == graph.nodes.count() and back.edges.count() == graph.edges.count()
    store.save(Graph(graph.nodes.limit(1), graph.edges.limit(1)), at)
    assert store.load(spark, at).nodes.count() == 1
    doc = {"format_version": 3, "nodes": [{"id": "a", "type": "class", "name": "A", "file_path": "a.py", "line_start": 1}], "edges": [{"source_id": "a", "target_id": "a", "edge_type": "calls", "properties": {"confidence": "high"}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = store.read_json(spark, f"file://{tmp_path}/g.json")
    assert g.edges.first().confidence == "high" and g.nodes.first().name == "A"
    (tmp_path / "new.json").write_text(json.dumps(doc | {"format_version": 99}))
    with pytest.raises(store.StoreError):
        store.read_json(spark, f"file://{tmp_path}/new.json")
    assert store.is_stale(str(tmp_path / "none")) and not store.is_stale(str(tmp_path / "g.json"))
    assert store.project_key("/x") == store.project_key("/x/")


def test_engine_answers(graph):
    e = Engine(graph)
    assert {r.name for r in e.ask("who calls total?").collect()} >= {"Service.check"}
    assert e.ask("make me a sandwich") is None
    assert [r.name for r in e.path("main", "Service.check").collect()][0] == "main"
    assert "Service.check" in Engine.render(e.callees("Service.save"))
    assert e.handle({"command": "search", "args": ["^Service"]})["ok"] and not e.handle({"command": "nope"})["ok"]
    assert {r["name"] for r in e.handle({"question": "exports of models.py"})["rows"]} == {"Order", "total"}
    assert e.summary().where("list = 'types'").count() >= 4
    assert {r.name for r in e.dead().collect()} >= {"checkout"}
    for name in ("deps", "rdeps", "file", "impact"):
        e.commands()[name]("models.py").count()


def test_pipeline_batches(spark, tmp_path):
    p = changes.ChangePipeline(spark, f"file://{tmp_path}/state")
    v = lambda rows: spark.createDataFrame(rows, "file_path string, seq bigint, content string")
    p.process(v([("a.py", 0, "def f(x):\n    return x\n"), ("b.py", 0, "from a import f\n\ndef g():\n    return f(1)\n")]), 0)
    assert p.graph().edges.where("edge_type = 'calls'").count() == 1
    p.process(v([("a.py", 1, "# a comment\ndef f(x):\n    return x\n")]), 1)  # no change of meaning
    assert p.ops().where("batch = 1").count() == 0
    p.process(v([("a.py", 2, "def h(x):\n    return x\n")]), 2)
    assert [(r.op_type, r.name, r.old_name) for r in p.ops().where("batch = 2").collect()] == [("update_node", "h", "f")]
    # no definition is left: the call falls back on any node of the name, which is the import itself
    g = p.graph()
    left = g.edges.where("edge_type = 'calls'").join(g.nodes, g.nodes["id"] == g.edges["target_id"]).select("type", "name", "confidence").collect()
    assert [tuple(r) for r in left] == [("import", "f", "low")]
    before = p.ops().count()
    p.process(v([("a.py", 3, "")]), 2)  # a batch that is done
    assert p.ops().count() == before
    p.process(v([("a.py", 3, "def broken(:\n")]), 3)
    assert p.ops().where("batch = 3").count() == 0 and p.graph().nodes.where("name = 'h'").count() == 1
    p.process(v([("a.py", 4, "")]), 4)
    assert [(r.op_type, r.name) for r in p.ops().where("batch = 4").collect()] == [("remove_node", "h")]


def test_pipeline_as_a_stream_restarts(spark, tmp_path):
    schema = "file_path string, seq bigint, content string"
    src, at, cp = f"{tmp_path}/in", f"file://{tmp_path}/state", f"{tmp_path}/cp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("a.py", 0, "def f():\n    return 1\n")])
    for _ in range(2):
        p = changes.ChangePipeline(spark, at)
        q = p.start(spark.readStream.schema(schema).parquet(src), cp)
        q.awaitTermination()
        write([("a.py", 1, "def f():\n    return 2\n")])
    assert sorted((r.batch, r.op_type, r.name) for r in p.ops().collect()) == [(0, "add_node", "f"), (1, "update_node", "f")]


def test_windows(spark):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 05:00:00")], "file string, t string").select("file", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.n for r in windows.sessions(e, "30 minutes").collect()) == [1, 2]
    assert [r.n for r in windows.tumbling(e, "1 day", by="file").collect()] == [3]


def test_files_of_one_row_group_are_many_tasks(spark, sf):
    n = generated.files(spark, sf, generated.PYTHON).groupBy(F.spark_partition_id()).count().collect()
    assert len(n) >= 4 and max(r["count"] for r in n) <= 2 * min(r["count"] for r in n)


def test_one_walk_finds_what_a_walk_for_each_definition_does():
    for source in [typing.__file__, json.decoder.__file__, python_ast.__file__]:
        text = Path(source).read_text()
        tree = ast.parse(text)
        assert [python_ast._dump(s, {}) for s in tree.body] == [ast.dump(s) for s in tree.body]
        loads = lambda n: [x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)]
        defined = {n.lineno: loads(n) for n in ast.walk(tree) if isinstance(n, (*python_ast.FUNCTIONS, ast.ClassDef))}
        found = {e.line_start: e.uses for e in python_ast.extract(text) if e.entity_type in ("class", "function")}
        assert found and all(defined[k] == v for k, v in found.items())
    deep = "".join(" " * k + f"def f{k}():\n" for k in range(60)) + " " * 60 + "x = A()\n" + " " * 60 + "g()\n"
    inner = [e for e in python_ast.extract(deep) if e.name.endswith("f59")]
    assert inner[0].calls == ["A", "g"] and inner[0].type_context == {"x": "A"}
    assert python_ast._dump(ast.parse("x = None\ndef f(*, a): pass").body[0], {}) == "Assign(targets=[Name(id='x', ctx=Store())], value=Constant(value=None))"


def test_entity_batch_keeps_every_field():
    e = Entity("function", "f", 1, 2, "s", "t", ["a"], ["b"], ["c"], [{"module": "m", "name": "n"}], ["d"], ["p"], ["q"], {"x": "A"})
    rows = entity_batch([("a.py", [e, e]), ("b.py", [])]).to_pylist()
    assert rows == [{"file_path": "a.py", "ord": k, **e.row(), "type_context": [("x", "A")]} for k in (0, 1)]
    assert entity_batch([]).num_rows == 0


def test_patterns_without_their_word_are_not_searched():
    from weftgraph.extract import patterns

    for spec in patterns.LANGUAGES.values():
        x = patterns.Extractor(spec)
        for _, p, word in [*x.declarations, *x.imports]:
            for source in [*samples.FILES.values(), *samples.BROKEN.values(), *(t for _, t in generated._BRACES.values())]:
                assert all(word in m[0] for m in p.finditer(source))
    assert [w for _, _, w in patterns.Extractor(patterns.LANGUAGES["java"]).declarations] == ["(", "(", "class", "interface", "{", "@interface"]


@pytest.mark.parametrize("text", ["a { b { c } d } e", "} a { b", "{ { }", "", "} } {}", "{}{{}}"])
def test_blocks_end_where_counting_braces_does(text):
    from weftgraph.extract import patterns

    def plain(at):
        depth = 0
        for i in range(at, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if text[i] == "}" and depth <= 0:
                return i + 1
        return len(text)

    b = patterns._Braces(text)
    assert [b.end(k, len(text)) for k in range(len(text))] == [plain(k) for k in range(len(text))]


def test_modules_of_one_row_group_are_parsed_in_many_tasks(spark, sf):
    f = generated.files(spark, sf, generated.MODULE).withColumn("seq", F.lit(0).cast("bigint"))
    n = changes.entities_of(f).groupBy(F.spark_partition_id()).count().collect()
    assert len(n) >= 4 and sum(r["count"] for r in n) == 5 * f.count()


def test_nodes_of_a_project_are_not_shuffled(spark):
    twice = "def f():\n    return a()\n\nX = 1\n\ndef f():\n    return b()\n"
    f = spark.createDataFrame([*samples.FILES.items(), ("twice.py", twice), ("broken.py", "def (")], "file_path string, content string")
    got = changes.project_nodes(f)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = changes.nodes_of(changes.entities_of(f.withColumn("seq", F.lit(0).cast("bigint"))))
    assert got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    assert [(r.ord, r.calls) for r in got.where("file_path = 'twice.py' AND name = 'f'").collect()] == [(2, ["b"])]


def test_ranks_are_tried_on_what_is_left(spark, sf, monkeypatch):
    tried = {}

    def counted(name):
        whole = getattr(resolve, name)

        def run(r, *more):
            tried.setdefault(name, []).append(r.count())
            return whole(r, *more)

        monkeypatch.setattr(resolve, name, run)

    for name in ("nearest", "inherited", "anywhere"):
        counted(name)
    f = generated.files(spark, sf, generated.MODULE, once=True)
    k = f.count()
    changes.named_edges(shared_table(changes.project_nodes(f), "nodes"))
    # of five names a module looks for, self_{k} alone is nowhere; no method is left for ancestors
    assert tried["anywhere"] == [k] and "inherited" not in tried and tried["nearest"][1] == k and tried["nearest"][0] <= 5 * k


def test_edges_carry_the_names_of_both_ends(spark, graph):
    n = {r.id: r for r in graph.nodes.collect()}
    e = changes.named_edges(graph.nodes).collect()
    assert e and all((n[r.source_id].name, n[r.target_id].name, n[r.target_id].file_path) == (r.source, r.target, r.target_file) for r in e)
    assert {(r.source_id, r.target_id, r.edge_type, r.confidence) for r in e} == {tuple(r) for r in graph.edges.select("source_id", "target_id", "edge_type", "confidence").collect()}


def test_a_method_left_over_is_an_ancestors(spark):
    code = {"base.py": "class Base:\n    def save(self):\n        return 1\n", "sub.py": "from base import Base\n\nclass Sub(Base):\n    def run(self):\n        return self.save()\n", "far.py": "from os import path\nfrom sub import *\n\ndef go(s: Sub):\n    return s.save()\n"}
    n = shared_table(changes.project_nodes(spark.createDataFrame(list(code.items()), "file_path string, content string")), "nodes")
    got = {(r.source, r.edge_type, r.target, r.confidence) for r in changes.named_edges(n).collect()}
    assert {("Sub.run", "calls", "Base.save", "low"), ("go", "calls", "Base.save", "low"), ("Sub", "inherits", "Base", "high"), ("*", "imports", "Sub", "medium")} <= got
