"""The registered queries, each with the SQL that it equals where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import extract, router
from ..functions import names as N
from ..functions import tokens as T
from ..operators import alerts, context, cycles, dead, delta, lookup, mutate, propagate, reports, resolve, stats, traverse, versioning
from ..session import shared_dir, shared_table
from ..streaming import changes, keystrokes, windows
from . import generated, samples
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name; ``sql`` goes after the views' common table expressions."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ctes, body = [v.strip() for v in views], sql.strip()
            own = body.removeprefix("WITH ")
            join = ",\n" if own != body else "\n"  # the query's own expressions follow the views'
            ORACLE_SQL[fn.__name__] = ("WITH RECURSIVE " if ctes or own != body else "") + ",\n".join(ctes) + (join if ctes else "") + own
        return fn

    return add


G, CH, LG, IM = V.GRAPH_SQL, V.CHANGES_SQL, V.LOG_SQL, V.IMPORTS_SQL


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.nodes(spark, sf), V.edges(spark, sf)


def _big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# --- lookups and one-hop joins ------------------------------------------------------------------

_CALLERS = """SELECT t.name AS of_name, coalesce(s.name, e.source_id) AS name, s.type, s.file_path, s.line_start, edge_type, confidence
FROM edges e JOIN nodes t ON t.id = e.target_id LEFT JOIN nodes s ON s.id = e.source_id WHERE t.name LIKE '%.s1'"""


@query(_CALLERS, G)
def callers(spark, sf):
    return lookup.callers(*_graph(spark, sf), "s1")


@query(_CALLERS + " AND confidence = 'high'", G)
def callers_high(spark, sf):
    return lookup.callers(*_graph(spark, sf), "s1", high_only=True)


@query(
    """SELECT s.name AS of_name, coalesce(t.name, e.target_id) AS name, t.type, t.file_path, t.line_start, edge_type, confidence
FROM edges e JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id WHERE s.name LIKE '%.c1'""",
    G,
)
def callees(spark, sf):
    return lookup.callees(*_graph(spark, sf), "c1")


@query("SELECT source_file AS file_path, target_file AS dep, edge_type FROM fe WHERE source_file = (SELECT min(file_path) FROM nodes WHERE file_path LIKE '%n7.py')", G)
def file_deps(spark, sf):
    return lookup.file_deps(*_graph(spark, sf), "n7.py")


@query("SELECT target_file AS file_path, source_file AS dep, edge_type FROM fe WHERE target_file = (SELECT min(file_path) FROM nodes WHERE file_path LIKE '%n7.py')", G)
def file_rdeps(spark, sf):
    return lookup.file_rdeps(*_graph(spark, sf), "n7.py")


@query(
    """SELECT name, type, file_path, line_start, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM nodes
LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY 1) o ON o.source_id = id LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) i ON i.target_id = id
WHERE file_path = (SELECT min(file_path) FROM nodes WHERE file_path LIKE '%n3.py')""",
    G,
)
def file_entities(spark, sf):
    return lookup.file_entities(*_graph(spark, sf), "n3.py")


@query(
    """SELECT n.id, n.name, n.type, n.file_path, n.line_start,
coalesce((SELECT string_agg(edge_type || ':' || t.name, ',' ORDER BY edge_type || ':' || t.name) FROM edges JOIN nodes t ON t.id = target_id WHERE source_id = n.id), '') AS out_edges,
coalesce((SELECT string_agg(edge_type || ':' || s.name, ',' ORDER BY edge_type || ':' || s.name) FROM edges JOIN nodes s ON s.id = source_id WHERE target_id = n.id), '') AS in_edges
FROM nodes n WHERE n.name = 'N5'""",
    G,
)
def entity_detail(spark, sf):
    return lookup.entity_detail(*_graph(spark, sf), "N5")


@query("SELECT * FROM nodes WHERE type = 'function' AND file_path = 'src/R1/n1.py'", G)
def node_filter(spark, sf):
    return lookup.node_filter(V.nodes(spark, sf), file_path="src/R1/n1.py", kind="function")


@query("SELECT * FROM nodes WHERE regexp_matches(name, 'N1[0-9]\\.s[0-9]+$')", G)
def name_search(spark, sf):
    return lookup.name_search(V.nodes(spark, sf), r"N1[0-9]\.s[0-9]+$")


@query(
    """WITH r AS (SELECT *, CASE WHEN name = 's7' THEN 0 WHEN name LIKE '%.s7' THEN 1 WHEN regexp_matches(name, 's7') THEN 2 END AS k FROM nodes)
SELECT id, type, name, file_path, line_start FROM r WHERE k = (SELECT min(k) FROM r)""",
    G,
)
def resolve_progressive(spark, sf):
    return lookup.resolve(V.nodes(spark, sf), "s7")


@query("SELECT file_path, name FROM nodes WHERE instr(name, '.') = 0", G)
def exports(spark, sf):
    return lookup.exports(V.nodes(spark, sf))


@query("SELECT DISTINCT source_id, target_id, edge_type FROM edges WHERE source_id <> target_id", G)
def distinct_edges(spark, sf):
    return lookup.distinct_edges(V.edges(spark, sf).select("source_id", "target_id", "edge_type").where("source_id <> target_id"))


@query("SELECT source_id, target_id, confidence FROM edges WHERE edge_type = 'calls' AND confidence = 'high'", G)
def high_confidence_calls(spark, sf):
    return V.edges(spark, sf, "calls").where("confidence = 'high'").select("source_id", "target_id", "confidence")


# --- aggregates ----------------------------------------------------------------------------------


@query("SELECT type, count(*) AS n FROM nodes GROUP BY 1", G)
def type_histogram(spark, sf):
    return stats.histogram(V.nodes(spark, sf), "type")


@query("SELECT edge_type, count(*) AS n FROM edges GROUP BY 1", G)
def edge_type_histogram(spark, sf):
    return stats.histogram(V.edges(spark, sf), "edge_type")


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT file_path) FROM nodes) AS n_files, (SELECT count(*) FROM edges) AS n_edges", G)
def totals(spark, sf):
    return stats.totals(*_graph(spark, sf))


@query("SELECT file_path, count(*) AS n_entities, count(DISTINCT type) AS n_types FROM nodes GROUP BY 1", G)
def entities_per_file(spark, sf):
    return stats.entities_per_file(V.nodes(spark, sf))


@query("SELECT regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS class_name, count(*) AS n_methods FROM nodes WHERE type = 'function' AND instr(name, '.') > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", G)
def top_classes(spark, sf):
    return stats.top_classes(V.nodes(spark, sf))


_FAN = """WITH x AS (SELECT {0}.id, {0}.name, {0}.file_path, {0}.line_start, count(*) AS n FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE s.file_path <> t.file_path GROUP BY ALL)
SELECT name, arg_max(n, file_path || lpad(CAST(line_start AS VARCHAR), 20, '0') || id) AS {1} FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


@query(_FAN.format("t", "n_in"), G)
def fan_in(spark, sf):
    return stats.fan(*_graph(spark, sf), incoming=True)


@query(_FAN.format("s", "n_out"), G)
def fan_out(spark, sf):
    return stats.fan(*_graph(spark, sf), incoming=False)


@query("SELECT file_path, CAST(sum(n) AS BIGINT) AS n_edges FROM (SELECT source_file AS file_path, n FROM fe UNION ALL SELECT target_file, n FROM fe) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", G)
def hot_files(spark, sf):
    return stats.hot_files(*_graph(spark, sf))


@query("SELECT source_file, target_file, edge_type, n FROM fe", G)
def cross_file_edges(spark, sf):
    return lookup.file_edges(*_graph(spark, sf))


@query(
    """WITH lanes AS (SELECT sha256('n:' || id || ':' || type || ':' || name || ':' || file_path) AS h FROM nodes UNION ALL SELECT sha256('e:' || source_id || ':' || target_id || ':' || edge_type) FROM edges)
SELECT left(sha256(concat_ws('|', CAST(sum(CAST('0x' || h[1:15] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[16:30] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[31:45] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[46:60] AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))), 16) AS graph_hash, count(*) AS n_parts FROM lanes""",
    G,
)
def graph_hash(spark, sf):
    return stats.graph_hash(*_graph(spark, sf))


# --- traversals ----------------------------------------------------------------------------------


def _named(nodes: DataFrame, like: str) -> DataFrame:
    return nodes.where(F.col("name").like(like)).select("id")


_BFS = """WITH moves AS ({0}), walk AS (SELECT id, 0 AS depth FROM nodes WHERE name LIKE '{1}' UNION SELECT t, depth + 1 FROM walk JOIN moves ON s = id WHERE depth < {2})
SELECT n.id, n.name, n.type, n.file_path, CAST(min(depth) AS BIGINT) AS depth FROM walk JOIN nodes n USING (id) GROUP BY ALL HAVING min(depth) > 0"""
_OUT, _IN = "SELECT DISTINCT source_id AS s, target_id AS t FROM edges", "SELECT DISTINCT target_id AS s, source_id AS t FROM edges"


def _walk(spark, sf, like, direction, depth, kinds=None):
    n, e = V.nodes(spark, sf), _written(spark, sf, *(kinds or ()))
    return traverse.traverse(n, e, _named(n, like), kinds, direction, depth).withColumn("depth", F.col("depth").cast("bigint"))


@query(_BFS.format(_OUT, "%.c1", 3), G)
def bfs_out(spark, sf):
    return _walk(spark, sf, "%.c1", "out", 3)


@query(_BFS.format(_IN, "R1", 3), G)
def bfs_in(spark, sf):
    return _walk(spark, sf, "R1", "in", 3)


@query(_BFS.format(_OUT + " UNION " + _IN, "%.c1", 2), G)
def bfs_both(spark, sf):
    return _walk(spark, sf, "%.c1", "both", 2)


@query(_BFS.format(_OUT + " WHERE edge_type IN ('calls', 'uses_type')", "%.c1", 3), G)
def bfs_typed(spark, sf):
    return _walk(spark, sf, "%.c1", "out", 3, ["calls", "uses_type"])


@query(
    """WITH walk AS (SELECT id FROM nodes WHERE name LIKE '%.c1' UNION SELECT target_id FROM walk JOIN edges ON source_id = id)
SELECT id, id IN (SELECT id FROM walk) AS reachable FROM nodes WHERE type = 'class'""",
    G,
)
def reachable(spark, sf):
    n, e = V.nodes(spark, sf), _written(spark, sf)
    return traverse.reachable(e, _named(n, "%.c1"), n.where("type = 'class'"))


@query(
    """WITH m AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges), p0 AS (SELECT id, 0 AS hops, id AS path FROM nodes WHERE name LIKE '%.c2'),
p1 AS (SELECT t AS id, 1 AS hops, min(path || '>' || t) AS path FROM p0 JOIN m ON s = id WHERE t NOT IN (SELECT id FROM p0) GROUP BY t),
p2 AS (SELECT t AS id, 2 AS hops, min(path || '>' || t) AS path FROM p1 JOIN m ON s = id WHERE t NOT IN (SELECT id FROM p0 UNION ALL SELECT id FROM p1) GROUP BY t),
p3 AS (SELECT t AS id, 3 AS hops, min(path || '>' || t) AS path FROM p2 JOIN m ON s = id WHERE t NOT IN (SELECT id FROM p0 UNION ALL SELECT id FROM p1 UNION ALL SELECT id FROM p2) GROUP BY t)
SELECT id, CAST(hops AS BIGINT) AS hops, path FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""",
    G,
)
def shortest_path(spark, sf):
    n, e = V.nodes(spark, sf), _written(spark, sf)
    return traverse.shortest_paths(e, _named(n, "%.c2"), max_depth=3).withColumn("hops", F.col("hops").cast("bigint"))


_PATH_LEN = """WITH walk AS (SELECT id, 0 AS hops FROM nodes WHERE name LIKE '%.c2' UNION SELECT target_id, hops + 1 FROM walk JOIN edges ON source_id = id WHERE hops < 10)
SELECT n.name, CAST(min(hops) AS BIGINT) AS hops FROM walk JOIN nodes n USING (id) WHERE n.type = 'class' GROUP BY ALL"""


@query(_PATH_LEN, G)
def shortest_path_len(spark, sf):
    n, e = V.nodes(spark, sf), _written(spark, sf)
    p = traverse.shortest_paths(e, _named(n, "%.c2"), max_depth=10)
    return n.where("type = 'class'").join(p, "id").select("name", F.col("hops").cast("bigint").alias("hops"))


def _file_graph(spark, sf):
    """The edges between files, written once: traversals read them in every round."""
    return shared_table(lookup.file_edges(*_graph(spark, sf)), "files")


def _written(spark, sf, *kinds: str) -> DataFrame:
    """The edges, written once, for what reads them in every round."""
    return shared_table(V.edges(spark, sf, *kinds), "graph")


@query(
    """WITH seed AS (SELECT DISTINCT source_file AS f, 1 AS depth FROM fe WHERE target_file = 'src/R1/n1.py'),
walk AS (SELECT f, depth FROM seed UNION SELECT source_file, depth + 1 FROM walk JOIN fe ON target_file = f WHERE depth < 3 AND edge_type IN ('calls', 'imports', 'inherits'))
SELECT DISTINCT f AS file_path FROM walk WHERE f <> 'src/R1/n1.py'""",
    G,
)
def impact(spark, sf):
    return traverse.impact(_file_graph(spark, sf), "src/R1/n1.py")


@query(
    """WITH m AS (SELECT source_file AS a, target_file AS b FROM fe UNION SELECT target_file, source_file FROM fe), walk AS (SELECT 'src/R1/base.py' AS f, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN m ON a = f WHERE depth < 2)
SELECT f AS file_path, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1""",
    G,
)
def file_neighbourhood(spark, sf):
    return traverse.file_neighbourhood(_file_graph(spark, sf), "src/R1/base.py").withColumn("depth", F.col("depth").cast("bigint"))


@query("SELECT c.name AS child, p.name AS parent FROM edges JOIN nodes c ON c.id = source_id JOIN nodes p ON p.id = target_id WHERE edge_type = 'inherits' AND (contains(c.name, '1') OR contains(p.name, '1'))", G)
def inheritance_tree(spark, sf):
    return traverse.inheritance(V.nodes(spark, sf), V.edges(spark, sf, "inherits"), "1")


@query(
    """WITH near AS (SELECT id FROM nodes WHERE name LIKE '%.c1')
SELECT source_id, target_id, edge_type, confidence FROM edges WHERE edge_type = 'calls' AND (source_id IN (SELECT id FROM near) OR source_id IN (SELECT target_id FROM edges WHERE edge_type = 'calls' AND source_id IN (SELECT id FROM near)))""",
    G,
)
def call_graph(spark, sf):
    n, e = V.nodes(spark, sf), V.edges(spark, sf, "calls")
    return traverse.call_graph(n, e, _named(n, "%.c1"), 1).select("source_id", "target_id", "edge_type", "confidence")


@query(
    """WITH i AS (SELECT source_id AS a, target_id AS b FROM edges WHERE edge_type = 'inherits' UNION SELECT 's' || s_suppkey, 's' || (s_suppkey + 5) FROM supplier WHERE s_suppkey % 41 <> 0),
both_ways AS (SELECT a, b FROM i UNION SELECT b, a FROM i), walk AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT w.id, x.b FROM walk w JOIN both_ways x ON x.a = w.other)
SELECT id, min(other) AS root FROM walk GROUP BY id""",
    G,
)
def connected_components(spark, sf):
    """Of stars of classes and of chains of suppliers, each five keys on, with gaps."""
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    chains = V.table(spark, sf, "supplier").where(k % 41 != 0).select(name(k).alias("source_id"), name(k + 5).alias("target_id"))
    return traverse.components(V.edges(spark, sf, "inherits").select("source_id", "target_id").unionByName(chains).withColumn("edge_type", F.lit("x")))


# --- dead code and cycles ------------------------------------------------------------------------

_DEAD = """SELECT id, name, type, file_path, line_start FROM nodes n WHERE type NOT IN ('import', 'module_code', 'variable') AND name NOT IN ('main', '__main__', '__module__')
AND NOT EXISTS (SELECT 1 FROM edges WHERE target_id = n.id)"""


@query(_DEAD, G)
def dead_code(spark, sf):
    return dead.dead_code(V.nodes(spark, sf), _written(spark, sf))


@query(
    """SELECT id, name, type, file_path, line_start FROM nodes n WHERE type <> 'module_code' AND name NOT IN ('main', '__main__', '__module__') AND NOT EXISTS (SELECT 1 FROM edges WHERE target_id = n.id)""",
    G,
)
def dead_code_all(spark, sf):
    return dead.dead_code(V.nodes(spark, sf), _written(spark, sf), include_tests=True, include_framework=True, passive=("module_code",))


def _methods(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers as methods of nations, with namesakes in their regions: those of even keys are called there."""
    n, e = V.nodes(spark, sf), V.edges(spark, sf)
    own = n.where("type = 'function' AND name LIKE '%.s%'").select("name", F.regexp_extract("file_path", r"^src/(R\d+)/", 1).alias("r"), N.bare(F.col("name")).alias("m"))
    path = F.concat(F.lit("src/"), F.col("r"), F.lit("/base.py"))
    name = F.concat_ws(".", "r", "m")
    base = own.select(N.node_id(path, F.lit("function"), name).alias("id"), F.lit("function").alias("type"), name.alias("name"), path.alias("file_path"), F.lit(2).cast("bigint").alias("line_start"))
    called = base.where("CAST(regexp_extract(name, 's([0-9]+)$', 1) AS INT) % 2 = 0").select(F.lit("x").alias("source_id"), F.col("id").alias("target_id"), F.lit("calls").alias("edge_type"), F.lit("high").alias("confidence"))
    return n.unionByName(base), e.where("edge_type = 'inherits'").unionByName(called)


@query("SELECT id FROM nodes WHERE type = 'function' AND regexp_matches(name, '\\.s[0-9]*[02468]$')", G)
def override_live(spark, sf):
    return dead.override_live(*_methods(spark, sf))


@query("SELECT a.source_file AS a, a.target_file AS b FROM (SELECT DISTINCT source_file, target_file FROM fe) a JOIN (SELECT DISTINCT source_file, target_file FROM fe) b ON a.source_file = b.target_file AND a.target_file = b.source_file WHERE a.source_file < a.target_file", G)
def mutual_files(spark, sf):
    return cycles.mutual_files(_file_graph(spark, sf))


@query("WITH p AS (SELECT DISTINCT source_file AS a, target_file AS b FROM fe), reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a) SELECT a AS file_path FROM reach WHERE a = b", G)
def cyclic_files(spark, sf):
    return cycles.cyclic_files(_file_graph(spark, sf))


@query()
def minimal_cycles(spark, sf):
    return cycles.minimal_cycles(_file_graph(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"))


# --- versions of files ---------------------------------------------------------------------------

_SETS = """WITH sets AS (SELECT v.file_path, v.seq, trim(body) = '' AS blank, coalesce(string_agg(DISTINCT name || '=' || sig, '|' ORDER BY name || '=' || sig), '') AS now FROM versions v LEFT JOIN entities e USING (file_path, seq) GROUP BY ALL),
g AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY file_path ORDER BY seq), '') AS before FROM sets)
"""


@query(_SETS + "SELECT file_path, seq, now <> before AND NOT (now = '' AND NOT blank AND before <> '') AS passes FROM g", CH)
def semantic_gate(spark, sf):
    return delta.semantic_gate(*V.changes(spark, sf))


_PAIRS = """WITH uniq AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY file_path, seq, name ORDER BY ord DESC) = 1),
nxt AS (SELECT file_path, seq AS old_seq, lead(seq) OVER (PARTITION BY file_path ORDER BY seq) AS seq FROM versions),
olds AS (SELECT u.file_path, n.seq, name, type, sig, struct, line_start, line_end FROM uniq u JOIN nxt n ON n.file_path = u.file_path AND n.old_seq = u.seq WHERE n.seq IS NOT NULL),
d AS (SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.seq, o.seq) AS seq, coalesce(n.name, o.name) AS name, o.name AS oname, n.name AS nname, o.type AS ot, n.type AS nt, o.sig AS osig, n.sig AS nsig, o.struct AS os, n.struct AS ns, o.line_start AS ol, n.line_start AS nl, o.line_end AS oe, n.line_end AS ne
  FROM uniq n FULL OUTER JOIN olds o ON n.file_path = o.file_path AND n.seq = o.seq AND n.name = o.name),
k AS (SELECT *, CASE WHEN oname IS NULL THEN 'added' WHEN nname IS NULL THEN 'removed' WHEN osig <> nsig THEN 'modified' END AS kind FROM d),
c AS (SELECT r.file_path, r.seq, r.name AS old_name, a.name AS new_name, row_number() OVER (PARTITION BY r.file_path, r.seq, r.name ORDER BY a.nl, a.name) AS x, row_number() OVER (PARTITION BY r.file_path, r.seq, a.name ORDER BY r.ol, r.name) AS y
  FROM k r JOIN k a ON r.file_path = a.file_path AND r.seq = a.seq AND r.ot = a.nt AND r.os = a.ns WHERE r.kind = 'removed' AND a.kind = 'added' AND r.ol <= a.ne AND a.nl <= r.oe),
ren AS (SELECT file_path, seq, old_name, new_name FROM c WHERE x = 1 AND y = 1),
delta AS (SELECT file_path, seq, name, kind, CAST(NULL AS VARCHAR) AS old_name FROM k WHERE kind = 'modified' OR (kind = 'removed' AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_path = k.file_path AND ren.seq = k.seq AND ren.old_name = k.name))
  OR (kind = 'added' AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_path = k.file_path AND ren.seq = k.seq AND ren.new_name = k.name)) UNION ALL SELECT file_path, seq, new_name, 'modified', old_name FROM ren)
"""


@query(_PAIRS + "SELECT file_path, seq, old_name, new_name FROM ren", CH)
def renames(spark, sf):
    return delta.renames(*V.changes(spark, sf))


@query(_PAIRS + "SELECT file_path, seq, name, kind, old_name FROM delta", CH)
def delta_rows(spark, sf):
    return delta.delta_rows(*V.changes(spark, sf))


@query(_PAIRS + "SELECT file_path, seq, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed, count(*) FILTER (kind = 'modified') AS n_modified FROM delta GROUP BY 1, 2", CH)
def delta_counts(spark, sf):
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return delta.delta_rows(*V.changes(spark, sf)).groupBy("file_path", "seq").agg(n("added"), n("removed"), n("modified"))


@query(
    _PAIRS
    + """SELECT file_path, seq, name, kind, old_name, CASE kind WHEN 'removed' THEN 'remove_node' WHEN 'added' THEN 'add_node' ELSE 'update_node' END AS op_type,
row_number() OVER (PARTITION BY file_path, seq ORDER BY CASE kind WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, name) AS place FROM delta""",
    CH,
)
def op_feed(spark, sf):
    d = delta.op_feed(delta.delta_rows(*V.changes(spark, sf)))
    return d.withColumn("place", F.col("place").cast("bigint"))


@query(
    """SELECT t.id, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS had_callers FROM edges JOIN nodes t ON t.id = target_id JOIN nodes s ON s.id = source_id
WHERE t.type = 'class' AND s.file_path <> t.file_path GROUP BY 1""",
    G,
)
def had_callers(spark, sf):
    n = V.nodes(spark, sf)
    return delta.had_callers(n, V.edges(spark, sf, "uses_type", "inherits"), n.where("type = 'class'"))


# --- the operation log ---------------------------------------------------------------------------


@query("SELECT file, max(version) AS version FROM log GROUP BY 1", LG)
def file_versions(spark, sf):
    return versioning.file_versions(V.log(spark, sf))


@query("SELECT version, event_id, file, op_type, node_id FROM log WHERE version > (SELECT max(version) FROM log) - 1000", LG)
def log_trim(spark, sf):
    return versioning.retained(V.log(spark, sf)).select("version", "event_id", "file", "op_type", "node_id")


@query("SELECT version, event_id, op_type FROM log WHERE version > 100", LG)
def ops_since(spark, sf):
    return versioning.ops_since(V.log(spark, sf), 100, keep=None).select("version", "event_id", "op_type")


_PROPOSED = "p AS (SELECT 'p' || c_custkey AS prop_id, CASE WHEN c_custkey % 2 = 0 THEN 'update_node' ELSE 'remove_node' END AS mine, 'e' || CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS node_id FROM customer)"


def _proposed(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "customer")
    return c.select(F.concat(F.lit("p"), "c_custkey").alias("prop_id"), F.when(F.col("c_custkey") % 2 == 0, "update_node").otherwise("remove_node").alias("op_type"), F.concat(F.lit("e"), F.floor(F.abs("c_acctbal") / 10).cast("bigint")).alias("node_id"))


@query(
    f"WITH {_PROPOSED}, "
    """r AS (SELECT * FROM log WHERE version > (SELECT max(version) FROM log) - 1000), j AS (SELECT prop_id, version, CASE WHEN op_type = 'remove_node' THEN 'deletion' WHEN renamed_from IS NOT NULL THEN 'rename' WHEN op_type = 'update_node' AND mine = 'update_node' THEN 'concurrent_edit' END AS conflict FROM p JOIN r USING (node_id))
SELECT prop_id, version, conflict, CASE conflict WHEN 'deletion' THEN 'error' ELSE 'warning' END AS severity FROM j WHERE conflict IS NOT NULL""",
    LG,
)
def conflicts(spark, sf):
    return versioning.conflicts(versioning.retained(V.log(spark, sf)), _proposed(spark, sf))


@query(f"WITH {_PROPOSED} SELECT prop_id, mine AS op_type, node_id FROM p WHERE node_id NOT IN (SELECT node_id FROM log WHERE op_type = 'remove_node')", LG)
def deletion_fix(spark, sf):
    return versioning.deletion_fix(_proposed(spark, sf), V.log(spark, sf)).select("prop_id", "op_type", "node_id")


@query(
    """WITH calls AS (SELECT CAST(o_custkey AS VARCHAR) AS prop_id, o_orderkey, 'old' || CAST(o_orderkey % 200 AS VARCHAR) AS name FROM orders), m AS (SELECT DISTINCT renamed_from FROM log WHERE renamed_from IS NOT NULL)
SELECT prop_id, string_agg(CASE WHEN renamed_from IS NULL THEN name ELSE 'new' || substr(name, 4) END, ',' ORDER BY o_orderkey) AS names FROM calls LEFT JOIN m ON name = renamed_from GROUP BY 1""",
    LG,
)
def rename_fix(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("prop_id"), "o_orderkey", F.concat(F.lit("old"), (F.col("o_orderkey") % 200).cast("string")).alias("name"))
    p = o.groupBy("prop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "name"))), lambda x: x["name"]).alias("names"))
    r = V.log(spark, sf).where("renamed_from IS NOT NULL").select(F.col("renamed_from").alias("old_name"), F.concat(F.lit("new"), F.substring("renamed_from", 4, 100)).alias("new_name")).distinct()
    return versioning.rename_fix(p, r).select("prop_id", F.array_join("names", ",").alias("names"))


@query(
    """WITH cur AS (SELECT max(version) AS v FROM log), s AS (SELECT o_orderkey AS session_id, o_orderkey % 12000 AS base, o_orderstatus <> 'P' AS known, o_orderkey % 3 AS np, o_orderkey % 2 AS nc FROM orders)
SELECT session_id, v - base AS drift, CASE WHEN NOT known THEN 'error' WHEN v = base THEN 'clean' WHEN np = 0 THEN 'clean_with_drift' WHEN nc > 0 THEN 'conflicts' ELSE 'clean_with_drift' END AS status,
known AND (v = base OR np = 0 OR nc = 0) AS can_apply FROM s, cur""",
    LG,
)
def session_status(spark, sf):
    cur = V.table(spark, sf, "events").count()
    o = V.table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 12000).alias("base_version"), (F.col("o_orderstatus") != "P").alias("known"), (F.col("o_orderkey") % 3).alias("n_proposed"), (F.col("o_orderkey") % 2).alias("n_conflicts"))
    return versioning.session_status(s, cur).select("session_id", F.col("drift").cast("bigint").alias("drift"), "status", "can_apply")


# --- modules, imports, targets -------------------------------------------------------------------

_SUFFIX = """WITH f AS (SELECT file_path, min(ord) AS ord, list_filter(string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/'), lambda x: x <> '') AS parts FROM site GROUP BY file_path),
sx AS (SELECT file_path, ord, array_to_string(parts[i:], '.') AS suffix FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM f))
"""


def _modules(spark, sf) -> DataFrame:
    return V.site(spark, sf).groupBy("file_path").agg(F.min("ord").alias("ord"))


@query(_SUFFIX + "SELECT suffix, arg_min(file_path, lpad(CAST(ord AS VARCHAR), 20, '0') || file_path) AS file_path FROM sx GROUP BY 1", IM)
def module_index(spark, sf):
    return resolve.module_index(_modules(spark, sf))


@query(_SUFFIX + "SELECT suffix, count(DISTINCT file_path) AS n_files FROM sx GROUP BY 1 HAVING count(DISTINCT file_path) > 1", IM)
def module_collisions(spark, sf):
    return resolve.module_collisions(_modules(spark, sf))


@query("SELECT target AS name, count(DISTINCT file_path) AS n_files FROM links GROUP BY 1", IM)
def dependency_index(spark, sf):
    return stats.dependency_index(V.links(spark, sf).withColumnRenamed("target", "name"))


@query(
    """SELECT DISTINCT i.source_file AS file_path, n.name, i.target_file AS from_file, 'medium' AS confidence, true AS via_star FROM fe i JOIN nodes n ON n.file_path = i.target_file WHERE i.edge_type = 'inherits' AND instr(n.name, '.') = 0""",
    G,
)
def star_import(spark, sf):
    n = V.nodes(spark, sf)
    i = lookup.file_edges(n, V.edges(spark, sf, "inherits")).select(F.col("source_file").alias("file_path"), "target_file")
    return resolve.star_import(i, lookup.exports(n))


@query(
    """WITH st AS (SELECT c_custkey AS a, c_custkey // 3 AS t, (c_custkey // 3) % 7 = 0 AS defines FROM customer WHERE c_custkey > 0),
w AS (SELECT a AS start, t, defines, 1 AS hops FROM st UNION ALL SELECT w.start, st.t, st.defines, hops + 1 FROM w JOIN st ON st.a = w.t WHERE NOT w.defines AND hops < 5)
SELECT start, arg_min(t, hops) AS definition, CAST(min(hops) AS BIGINT) AS hops FROM w WHERE defines GROUP BY 1"""
)
def reexport_chain(spark, sf):
    c = V.table(spark, sf, "customer").where("c_custkey > 0")
    to = F.expr("c_custkey div 3")
    steps = c.select(F.col("c_custkey").alias("at"), to.alias("to"), (to % 7 == 0).alias("defines"))
    return resolve.reexport_chain(steps).withColumn("hops", F.col("hops").cast("bigint"))


_RESOLVE = """WITH refs AS (SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 5 = 0 THEN 'N' || (o_orderkey % 30) ELSE 's' || (o_orderkey % 150) END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'class' ELSE 'function' END AS kind, cfile AS file_path FROM orders JOIN cust ON o_custkey = c_custkey),
imp AS (SELECT DISTINCT source_file AS file_path, target_file FROM fe WHERE edge_type = 'inherits'),
cand AS (SELECT r.*, n.id AS target_id, n.line_start AS ord, n.name = r.name AS exact, n.file_path = r.file_path AS own, i.target_file IS NOT NULL AS known, n.file_path AS tf FROM refs r JOIN nodes n ON n.type = r.kind AND (n.name = r.name OR n.name LIKE '%.' || r.name) LEFT JOIN imp i ON i.file_path = r.file_path AND i.target_file = n.file_path),
ranked AS (SELECT *, CASE WHEN own THEN CASE WHEN exact THEN 5 ELSE 8 END WHEN known THEN CASE WHEN exact THEN 3 ELSE 6 END ELSE CASE WHEN exact THEN 4 ELSE 7 END END AS rank,
  len(list_filter(generate_series(1, 3), lambda i: string_split(file_path, '/')[:i] = string_split(tf, '/')[:i] AND len(string_split(tf, '/')) >= i)) AS shared FROM cand),
best AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, CASE WHEN rank IN (4, 7) THEN -shared ELSE 0 END, CASE WHEN rank IN (4, 7) THEN ord ELSE -ord END, target_id) AS k, count(*) OVER (PARTITION BY ref_id) AS n FROM ranked)
SELECT r.ref_id, r.name, b.target_id, CAST(b.rank AS BIGINT) AS rank, CASE b.rank WHEN 3 THEN 'high' WHEN 7 THEN 'low' WHEN 8 THEN 'low' WHEN 4 THEN 'medium' WHEN 5 THEN 'medium' WHEN 6 THEN 'medium' END AS confidence, b.n AS n_candidates FROM refs r LEFT JOIN best b ON b.ref_id = r.ref_id AND b.k = 1"""


def _references(spark, sf) -> DataFrame:
    c, _ = V._members(spark, sf)
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    five = F.col("o_orderkey") % 5 == 0
    name = F.when(five, F.concat(F.lit("N"), (F.col("o_orderkey") % 30).cast("string"))).otherwise(F.concat(F.lit("s"), (F.col("o_orderkey") % 150).cast("string")))
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return r.select(F.col("o_orderkey").alias("ref_id"), name.alias("name"), F.when(five, "class").otherwise("function").alias("kind"), "file_path")


def _resolved(spark, sf) -> DataFrame:
    n = V.nodes(spark, sf)
    i = lookup.file_edges(n, V.edges(spark, sf, "inherits")).select("source_file", "target_file").distinct()
    imported = i.select(F.col("source_file").alias("file_path"), F.col("target_file").alias("imported"))
    return resolve.resolve_targets(_references(spark, sf), n.withColumn("ord", F.col("line_start")), imported)


@query(_RESOLVE, G)
def resolve_targets(spark, sf):
    return _resolved(spark, sf).select("ref_id", "name", "target_id", F.col("rank").cast("bigint").alias("rank"), "confidence", "n_candidates")


@query(
    _RESOLVE.replace("SELECT r.ref_id, r.name, b.target_id", ", res AS (SELECT r.ref_id, r.name, b.target_id")
    + """) SELECT count(*) AS total, count(*) FILTER (target_id IS NOT NULL) AS resolved, count(*) FILTER (n_candidates > 1) AS ambiguous, count(*) FILTER (name LIKE 'N2%') AS external,
round(count(*) FILTER (target_id IS NOT NULL) / count(*), 6) AS rate, round(count(*) FILTER (target_id IS NOT NULL) / (count(*) - count(*) FILTER (name LIKE 'N2%')), 6) AS effective_rate FROM res""",
    G,
)
def resolution_rate(spark, sf):
    r = _resolved(spark, sf)
    return stats.resolution_rate(r.select(F.col("target_id").isNotNull().alias("resolved"), (F.coalesce("n_candidates", F.lit(0)) > 1).alias("ambiguous"), F.col("name").like("N2%").alias("external")))


@query(_RESOLVE.replace("SELECT r.ref_id, r.name, b.target_id", ", res AS (SELECT r.ref_id, r.name, b.target_id") + ") SELECT name, count(*) AS n FROM res WHERE target_id IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", G)
def unresolved_top(spark, sf):
    r = _resolved(spark, sf).where("target_id IS NULL")
    return lookup.top_k(r.groupBy("name").agg(F.count("*").alias("n")), 20, F.desc("n"), F.col("name"))


@query(
    """WITH cl AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'x.N' || (o_orderkey % 30) || '.s' || (o_orderkey % 150) WHEN 1 THEN 's' || (o_orderkey % 150) ELSE 'y.q' || (o_orderkey % 40) END AS name FROM orders),
known AS (SELECT DISTINCT t.name FROM edges JOIN nodes t ON t.id = target_id WHERE edge_type = 'calls' AND confidence = 'high')
SELECT name, count(*) AS n FROM cl WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.name = cl.name OR ends_with(known.name, '.' || cl.name) OR ends_with(cl.name, '.' || known.name)) GROUP BY 1""",
    G,
)
def unresolved_calls(spark, sf):
    k = F.col("o_orderkey")
    s = lambda m: (k % m).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("x.N"), s(30), F.lit(".s"), s(150))).when(k % 3 == 1, F.concat(F.lit("s"), s(150))).otherwise(F.concat(F.lit("y.q"), s(40)))
    high = V.edges(spark, sf, "calls").where("confidence = 'high'").select(F.col("target_id").alias("id")).distinct()
    return stats.unresolved_calls(V.table(spark, sf, "orders").select(name.alias("name")), V.nodes(spark, sf).join(high, "id", "left_semi"))


@query(
    """SELECT o_orderkey AS ref_id, left(sha256('src/R' || n_regionkey || '/base.py:function:R' || n_regionkey || '.s' || s_suppkey), 16) AS target_id, CAST(1 AS BIGINT) AS depth
FROM orders JOIN cust ON o_custkey = c_custkey JOIN nation ON n_nationkey = cn JOIN (SELECT s_suppkey, n_regionkey AS sr FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = o_orderkey % 150 AND sr = n_regionkey""",
    G,
)
def inherited_method(spark, sf):
    n, e = _methods(spark, sf)
    r = _references(spark, sf).select("ref_id", F.concat(F.lit("N"), F.regexp_extract("file_path", r"n(\d+)\.py$", 1)).alias("class_name"), F.concat(F.lit("s"), (F.col("ref_id") % 150).cast("string")).alias("method"))
    return resolve.inherited_method(r, n, e).withColumn("depth", F.col("depth").cast("bigint"))


# --- reversible operations -----------------------------------------------------------------------


def _gone(n: DataFrame) -> DataFrame:
    return n.where("file_path = 'src/R1/n1.py'")


@query("WITH gone AS (SELECT id FROM nodes WHERE file_path = 'src/R1/n1.py') SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)", G)
def op_apply(spark, sf):
    n, e = _graph(spark, sf)
    return mutate.remove_nodes(mutate.Graph(n, e), _gone(n)).edges.select("source_id", "target_id", "edge_type")


@query("SELECT source_id, target_id, edge_type FROM edges", G)
def op_undo(spark, sf):
    n, e = _graph(spark, sf)
    before = mutate.Graph(n, e)
    return mutate.restore(mutate.remove_nodes(before, _gone(n)), before, _gone(n)).edges.select("source_id", "target_id", "edge_type")


@query("SELECT id, CASE WHEN type = 'class' THEN name || '_v2' ELSE name END AS name, CASE WHEN type = 'class' THEN 'moved/' || file_path ELSE file_path END AS file_path FROM nodes", G)
def op_rename_move(spark, sf):
    n = V.nodes(spark, sf)
    c = n.where("type = 'class'")
    g = mutate.rename_nodes(mutate.Graph(n, V.edges(spark, sf, "inherits")), c.select("id", F.concat("name", F.lit("_v2")).alias("name")))
    g = mutate.move_nodes(g, c.select("id", F.concat(F.lit("moved/"), "file_path").alias("file_path"), "line_start"))
    return g.nodes.select("id", "name", "file_path")


@query(
    """WITH have AS (SELECT 'e' || CAST(p_partkey AS VARCHAR) AS node_id FROM part), s AS (SELECT *, last_value(CASE op_type WHEN 'add_node' THEN true WHEN 'remove_node' THEN false END IGNORE NULLS) OVER (PARTITION BY file, node_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM log),
j AS (SELECT file, CASE WHEN op_type = 'add_node' THEN NOT coalesce(st, node_id IN (SELECT node_id FROM have)) ELSE coalesce(st, node_id IN (SELECT node_id FROM have)) END AS ok FROM s)
SELECT file AS batch_id, count(*) AS n_ops, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (NOT ok) = 0 AS applied FROM j GROUP BY 1""",
    LG,
)
def batch_rollback(spark, sf):
    ops = V.log(spark, sf).select(F.col("file").alias("batch_id"), F.col("version").alias("place"), "op_type", "node_id")
    have = V.table(spark, sf, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"))
    return mutate.batch_status(ops, have)


# --- propagation and zones -----------------------------------------------------------------------

_PRIO = """WITH m AS (SELECT DISTINCT target_file AS a, source_file AS b FROM fe), walk AS (SELECT 'src/R1/base.py' AS f, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN m ON a = f WHERE depth < 3),
d AS (SELECT f AS file_path, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0),
p AS (SELECT file_path, CAST(depth AS BIGINT) AS depth, CAST(20 * depth - CASE WHEN file_path LIKE '%0.py' THEN 100 ELSE 0 END - CASE WHEN file_path LIKE '%5.py' THEN 50 ELSE 0 END AS BIGINT) AS priority FROM d)
"""


def _prioritised(spark, sf) -> DataFrame:
    d = propagate.affected(_file_graph(spark, sf), "src/R1/base.py")
    path = F.col("file_path")
    p = propagate.file_priority(F.col("depth"), path.like("%0.py"), F.when(path.like("%5.py"), 10).otherwise(1000), path)
    return d.select("file_path", F.col("depth").cast("bigint").alias("depth"), p.cast("bigint").alias("priority"))


@query(_PRIO + "SELECT file_path, depth, priority FROM p", G)
def file_priority(spark, sf):
    return _prioritised(spark, sf)


@query(
    _PRIO
    + """, r AS (SELECT *, row_number() OVER (ORDER BY priority, depth, file_path) AS k FROM p)
SELECT file_path, depth, priority, CASE WHEN k <= 55 THEN k END AS place, CASE WHEN k <= 5 THEN 'sync' WHEN k <= 55 THEN 'async' ELSE 'deferred' END AS phase FROM r""",
    G,
)
def propagation_phases(spark, sf):
    return propagate.phases(_prioritised(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query(_PRIO + "SELECT file_path, priority FROM p ORDER BY priority, depth, file_path LIMIT 10", G)
def async_drain(spark, sf):
    p = _prioritised(spark, sf)
    return lookup.top_k(p, 10, F.col("priority"), F.col("depth"), F.col("file_path")).select("file_path", "priority")


_ZONES = """WITH acts AS (SELECT file, version, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'view' THEN 'open' ELSE 'access' END AS action FROM log),
lst AS (SELECT file, arg_max(action, version) AS action, max(version) AS version FROM acts GROUP BY 1), hot AS (SELECT file FROM lst WHERE action = 'open' ORDER BY version DESC, file LIMIT 10),
z AS (SELECT file, CASE WHEN file IN (SELECT file FROM hot) THEN 'HOT' ELSE 'WARM' END AS zone FROM lst)
"""


def _zoned(spark, sf) -> DataFrame:
    act = F.when(F.col("event_type").isin("signup", "view"), "open").when(F.col("event_type") == "purchase", "close").otherwise("access")
    return propagate.zones(V.log(spark, sf).select("file", "version", act.alias("action")))


@query(_ZONES + "SELECT file, zone FROM z", LG)
def zones(spark, sf):
    return _zoned(spark, sf)


@query(_ZONES + "SELECT zone, count(*) AS n FROM (SELECT coalesce(zone, 'COLD') AS zone FROM customer LEFT JOIN z ON file = CAST(c_custkey AS VARCHAR)) GROUP BY 1", LG)
def zone_stats(spark, sf):
    files = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file"))
    return stats.histogram(propagate.zone_of(files, _zoned(spark, sf)), "zone")


@query("SELECT file, CAST(100 - CASE WHEN arg_max(event_type, version) = 'view' THEN 50 ELSE 0 END - CASE WHEN epoch((SELECT max(ts) FROM log)) - epoch(max(ts)) < 60 THEN 30 ELSE 0 END AS BIGINT) AS priority FROM log GROUP BY 1", LG)
def zone_priority(spark, sf):
    lg = V.log(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = lg.agg(F.max("at").alias("now"))
    f = lg.groupBy("file").agg(F.max_by("event_type", "version").alias("kind"), F.max("at").alias("at")).join(F.broadcast(now))  # one row
    return f.select("file", propagate.zone_priority(F.col("kind") == "view", F.col("now") - F.col("at"), F.col("file")).cast("bigint").alias("priority"))


_GAPS = "WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY file ORDER BY version)) / 1000000.0 / 60 AS gap FROM log) "


def _gaps(spark, sf) -> DataFrame:
    """Minutes between a user's events, as the milliseconds of keystrokes."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.table(spark, sf, "events").withColumn("at", at)
    return e.select("event_id", ((F.col("at") - F.lag("at").over(w)) / 1000000.0 / 60).alias("gap"))


@query(_GAPS + "SELECT event_id, CAST(CASE WHEN gap > 500 THEN 3 WHEN gap > 200 THEN 2 WHEN gap > 50 THEN 1 ELSE -1 END AS BIGINT) AS tier FROM g", LG)
def debounce_gap_tiers(spark, sf):
    return _gaps(spark, sf).select("event_id", T.gap_tier(F.col("gap")).cast("bigint").alias("tier"))


@query(_GAPS + "SELECT event_id, round(CASE WHEN gap IS NULL THEN 300.0 WHEN gap <= 100 THEN 100.0 WHEN gap >= 500 THEN 500.0 ELSE gap END, 3) AS win FROM g", LG)
def adaptive_window(spark, sf):
    win = F.when(F.col("gap").isNull(), float(T.BASE_WINDOW)).otherwise(T.adaptive_window(F.col("gap")))
    return _gaps(spark, sf).select("event_id", F.round(win, 3).alias("win"))


# --- tokens, mentions, scores --------------------------------------------------------------------

_BUILTIN_LIST = ", ".join(f"'{x}'" for x in T.builtin_names())


@query(
    f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents)
SELECT token, count(*) AS n, CASE WHEN token IN ({_BUILTIN_LIST}) THEN 1.0::DOUBLE WHEN regexp_matches(token, '(_id|_name|_list|_map|_set|_dict|_type|_count|_path|_file)$') THEN 0.95 WHEN token LIKE '%\\_' ESCAPE '\\' THEN 0.3 WHEN length(token) < 2 THEN 0.2 WHEN contains(token, '_') THEN 0.85
WHEN upper(token) = token AND lower(token) <> token THEN 0.9 WHEN regexp_matches(substr(token, 2), '[A-Z]') THEN 0.85 ELSE 0.6 END AS confidence FROM t GROUP BY 1"""
)
def token_confidence(spark, sf):
    t = V.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", "n", T.token_confidence(F.col("token")).alias("confidence"))


_MENTION = """WITH it AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS token FROM benchmark), dt AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS token FROM documents)
"""


def _tokens_of(spark, sf, table, key) -> DataFrame:
    t = V.table(spark, sf, table)
    return t.select(key, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("token")).select(key, F.lower("token").alias("token")).distinct()


@query(_MENTION + "SELECT item_id, token, count(*) AS n_docs FROM it JOIN dt USING (token) GROUP BY 1, 2")
def mention_scan(spark, sf):
    # documents are counted by token first: a common token is joined once, not once for each document
    n = _tokens_of(spark, sf, "documents", "doc_id").groupBy("token").agg(F.count("*").alias("n_docs"))
    return _tokens_of(spark, sf, "benchmark", "item_id").join(n, "token").select("item_id", "token", "n_docs")


@query(_MENTION + "SELECT item_id, round(count(*) FILTER (token IN (SELECT token FROM dt)) / count(*), 6) AS accuracy, count(*) AS n_expected FROM it GROUP BY 1")
def accuracy_score(spark, sf):
    seen = _tokens_of(spark, sf, "documents", "doc_id").select("token").distinct().withColumn("hit", F.lit(True))
    i = _tokens_of(spark, sf, "benchmark", "item_id").join(seen, "token", "left")
    return i.groupBy("item_id").agg(F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"), F.count("*").alias("n_expected"))


_SAID = """WITH said AS (SELECT conv_id, turn, text, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM conversations),
m AS (SELECT conv_id, turn, coalesce(text, '') AS text, unnest([w[1], substr(w[2], 2), w[3] || '_', w[4] || '.py', upper(left(w[5], 1)) || lower(substr(w[5], 2)) || upper(left(w[6], 1)) || lower(substr(w[6], 2)), 'Ab' || 'Zz']) AS mention FROM said WHERE len(w) > 6),
p AS (SELECT *, lower(mention) AS lm, lower(text) AS lt, list_transform(regexp_extract_all(mention, '[A-Z][a-z]+'), lambda x: lower(x)) AS words FROM m),
f AS (SELECT conv_id, turn, CASE WHEN ends_with(lm, '_') THEN regexp_matches(lt, '(^|[\\s,;:({/])\\Q' || lm || '\\E') WHEN contains(lm, '/') OR ends_with(lm, '.py') OR ends_with(lm, '.ts') OR ends_with(lm, '.js') OR ends_with(lm, '.rs') THEN regexp_matches(lt, '(^|[\\s`"''/])\\Q' || lm || '\\E')
  ELSE regexp_matches(lt, '(^|[^a-z0-9_])\\Q' || lm || '\\E([^a-z0-9_]|$)') OR (regexp_matches(mention, '^([A-Z][a-z]+){2,}$') AND len(list_filter(generate_series(1, length(lt) - length(words[1]) + 1), lambda pos: substr(lt, pos, length(words[1])) = words[1] AND len(list_filter(words, lambda x: contains(substr(lt, greatest(pos - 20, 1), pos + 100 - greatest(pos - 20, 1)), x))) = len(words))) > 0) END AS found FROM p)
SELECT conv_id, turn, count(*) AS n_expected, count(*) FILTER (found) AS n_found, round(count(*) FILTER (found) / count(*), 6) AS accuracy FROM f GROUP BY 1, 2"""


@query(_SAID)
def accuracy_mentions(spark, sf):
    """Words of a turn as mentions: whole, without their first letter, as prefixes, as paths and in camel case."""
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("response"))
    c = c.withColumn("w", F.filter(F.split("response", " "), lambda x: x != "")).where(F.size("w") > 6)
    w = lambda k: F.element_at("w", k)
    cap = lambda k: F.concat(F.upper(F.substring(w(k), 1, 1)), F.lower(F.substring(w(k), F.lit(2), F.length(w(k)))))
    expected = F.array(w(1), F.substring(w(2), F.lit(2), F.length(w(2))), F.concat(w(3), F.lit("_")), F.concat(w(4), F.lit(".py")), F.concat(cap(5), cap(6)), F.lit("AbZz"))
    return reports.accuracy(c.select(F.struct("conv_id", "turn").alias("run"), expected.alias("expected"), "response"), "run").select("run.conv_id", "run.turn", "n_expected", "n_found", "accuracy")


_PROMPTS = """WITH q AS (SELECT c_custkey AS k, 'why does ' || cname || ' (see n' || (c_custkey % 30) || '.py) need p' || c_custkey || ', Brand and ./lib/?' AS text FROM cust JOIN customer USING (c_custkey)),
tk AS (SELECT DISTINCT k, trim(unnest(string_split_regex(text, '[\\s,;:?!`''"()\\[\\]{}]+')), './') AS token FROM q),
ent AS (SELECT name AS token, arg_min(file_path || ':' || line_start, file_path || lpad(CAST(line_start AS VARCHAR), 20, '0')) AS found FROM nodes GROUP BY 1),
hit AS (SELECT k, token, 'entity' AS kind, found FROM tk JOIN ent USING (token) WHERE length(token) >= 2
  UNION ALL SELECT k, token, 'file', min(file_path) FROM tk JOIN (SELECT DISTINCT file_path FROM nodes) ON contains(file_path, token) WHERE length(token) >= 2 AND token NOT IN (SELECT token FROM ent) GROUP BY 1, 2)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY kind, token) AS place, token, kind, found FROM hit QUALIFY place <= 5"""


@query(_PROMPTS, G)
def prompt_mentions(spark, sf):
    c, _ = V._members(spark, sf)
    key = F.col("c_custkey")
    text = F.concat(F.lit("why does "), "name", F.lit(" (see n"), (key % 30).cast("string"), F.lit(".py) need p"), key.cast("string"), F.lit(", Brand and ./lib/?"))
    return lookup.prompt_mentions(c.select(key.alias("k"), text.alias("text")), V.nodes(spark, sf), "k")


@query("SELECT o_orderpriority AS test_id, o_orderstatus AS mode, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1, 2")
def run_stats(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("test_id"), F.col("o_orderstatus").alias("mode"), "o_totalprice")
    return reports.mean_and_spread(o, ["test_id", "mode"], "o_totalprice")


@query("SELECT conv_id, round((sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / 4 * 3.0 + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / 4 * 15.0) / 1000000, 8) AS cost FROM conversations GROUP BY 1")
def cost_estimate(spark, sf):
    c = V.table(spark, sf, "conversations")
    size = lambda r: F.sum(F.when(F.col("role") == r, F.length("text")).otherwise(0)) / 4
    return c.groupBy("conv_id").agg(F.round(reports.cost(size("user"), size("assistant")), 8).alias("cost"))


@query("""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href="[^"]*"'))) AS BIGINT) AS n_references FROM pages""")
def file_references(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", reports.references(F.col("html"), 'href="[^"]*"').cast("bigint").alias("n_references"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS word FROM documents) GROUP BY 1")
def camel_words(spark, sf):
    return V.table(spark, sf, "documents").select(F.explode(reports.camel_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    """SELECT s.id AS source_id, arg_min(t.id, t.file_path || lpad(CAST(t.line_start AS VARCHAR), 20, '0') || t.id) AS target_id
FROM nodes s JOIN nodes t ON t.type = 'function' AND t.name = replace(s.name, '.c', '.s') WHERE s.type = 'function' AND s.name LIKE '%.c%' GROUP BY 1""",
    G,
)
def naive_calls(spark, sf):
    n = V.nodes(spark, sf)
    r = n.where("type = 'function' AND name LIKE '%.c%'").select(F.col("id").alias("source_id"), F.replace("name", F.lit(".c"), F.lit(".s")).alias("name"))
    return reports.naive_calls(n, r)


@query("SELECT id, '[' || type || '] ' || name || ' (' || file_path || ':' || line_start || ')' AS text FROM nodes", G)
def format_nodes(spark, sf):
    n = V.nodes(spark, sf)
    return n.select("id", context.format_node(F.col("type"), F.col("name"), F.col("file_path"), F.col("line_start")).alias("text"))


# --- scopes --------------------------------------------------------------------------------------

_SCOPES = "sc AS (SELECT p_partkey AS k, list_filter(string_split(p_type || ' ' || p_name, ' '), lambda x: x <> '') AS chain FROM part)"


def _scopes(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), F.filter(F.split(F.concat_ws(" ", "p_type", "p_name"), " "), lambda x: x != "").alias("chain"))


@query(
    "WITH "
    + _SCOPES
    + """, def AS (SELECT array_to_string(chain[:k % 3 + 1], '::') AS scope, 'v' || (k % 10) AS name, min(k) AS owner FROM sc GROUP BY 1, 2), look AS (SELECT k, chain, unnest(generate_series(0, len(chain))) AS lv FROM sc)
SELECT k, arg_max(owner, lv) AS owner, max(lv) AS level FROM look JOIN def ON scope = array_to_string(chain[:lv], '::') AND name = 'v' || (k % 7) GROUP BY 1"""
)
def scope_lookup(spark, sf):
    s = _scopes(spark, sf)
    defined = s.groupBy(F.array_join(F.expr("slice(chain, 1, CAST(k % 3 + 1 AS INT))"), "::").alias("scope"), F.concat(F.lit("v"), (F.col("k") % 10).cast("string")).alias("name")).agg(F.min("k").alias("owner"))
    return lookup.scope_lookup(s.withColumn("name", F.concat(F.lit("v"), (F.col("k") % 7).cast("string"))), defined, "k")


@query(
    """WITH span AS (SELECT o_custkey AS f, o_orderkey, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 40 AS b, o_orderkey % 6 AS depth FROM orders)
SELECT f, line, arg_max(o_orderkey, depth * 10000000000 - o_orderkey) AS entity FROM span JOIN (SELECT unnest([5, 20, 45]) AS line) ON line BETWEEN a AND b GROUP BY 1, 2"""
)
def entity_at_line(spark, sf):
    k = F.col("o_orderkey")
    s = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("f"), k.alias("entity"), (k % 50).alias("first"), (k % 50 + k % 40).alias("last"), (k % 6).alias("depth"))
    lines = s.select("f").distinct().select("f", F.explode(F.array(*map(F.lit, (5, 20, 45)))).alias("line"))
    return lookup.entity_at_line(s, lines, "f")


# --- context -------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT t.id AS tid, t.file_path, t.name, t.line_start, s.file_path AS cf, s.name AS caller, s.id AS sid, edge_type, s.file_path <> t.file_path AS other FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id),
sums AS (SELECT tid, file_path, name, line_start, count(*) FILTER (other) AS n_cross, count(*) FILTER (NOT other) AS n_same FROM c GROUP BY 1, 2, 3, 4),
best AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n_cross DESC, line_start, name, tid) AS place FROM sums QUALIFY place <= 3),
it AS (SELECT c.tid, other, row_number() OVER (PARTITION BY c.tid, other ORDER BY cf, caller, edge_type, sid) AS k, CASE WHEN other THEN string_split(cf, '/')[-1] || ':' || caller ELSE caller || ' (same file)' END AS label FROM c JOIN best USING (tid)),
li AS (SELECT tid, string_agg(label, ', ' ORDER BY k) FILTER (other AND k <= 3) AS far, string_agg(label, ', ' ORDER BY k) FILTER (NOT other AND k <= 2) AS near FROM it GROUP BY 1)
SELECT file_path, place, name, n_cross, n_same, concat_ws(', ', far, CASE WHEN n_cross > 3 THEN '+' || (n_cross - 3) || ' more' END, near) AS shown FROM best JOIN li USING (tid)""",
    G,
)
def caller_ranking(spark, sf):
    return context.caller_ranking(*_graph(spark, sf))


@query(
    """WITH gone AS (SELECT * FROM nodes WHERE type = 'function' AND file_path = 'src/R1/n1.py' AND name LIKE '%.s%'),
fresh AS (SELECT left(sha256(file_path || ':function:fresh_helper'), 16) AS id, 'fresh_helper' AS name, file_path, id AS class_id, name AS class_name FROM nodes WHERE type = 'class' AND name LIKE 'R%'),
an AS (SELECT id, name, file_path FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, name, file_path FROM fresh),
ae AS (SELECT source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) UNION ALL SELECT class_id, id FROM fresh WHERE class_name IN ('R0', 'R2', 'R4')
  UNION ALL SELECT target_id, source_id FROM edges JOIN nodes ON id = source_id WHERE edge_type = 'inherits' AND name IN ('N0', 'N9')),
pb AS (SELECT DISTINCT source_file AS a, target_file AS b FROM fe),
pa AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b FROM ae JOIN an s ON s.id = source_id JOIN an t ON t.id = target_id WHERE s.file_path <> t.file_path),
rb AS (SELECT a, b FROM pb UNION SELECT rb.a, pb.b FROM rb JOIN pb ON rb.b = pb.a), ra AS (SELECT a, b FROM pa UNION SELECT ra.a, pa.b FROM ra JOIN pa ON ra.b = pa.a),
lost AS (SELECT DISTINCT g.id, g.file_path, g.name AS subject, s.name AS caller FROM gone g JOIN edges ON target_id = g.id JOIN an s ON s.id = source_id)
SELECT 'broken' AS kind, file_path, subject, array_to_string(list_sort(list(caller))[1:3], ', ') AS detail, count(*) AS n FROM lost GROUP BY id, file_path, subject
UNION ALL SELECT 'unused', file_path, name, '', 0 FROM fresh WHERE id NOT IN (SELECT target_id FROM ae)
UNION ALL SELECT 'cycle', a, a, '', 0 FROM ra WHERE a = b AND a NOT IN (SELECT a FROM rb WHERE a = b)""",
    G,
)
def change_alerts(spark, sf):
    """A change that drops the suppliers of one file, adds a helper to each region's and turns two bases around as well."""
    n, e = V.nodes(spark, sf), _written(spark, sf)
    gone = n.where("type = 'function' AND file_path = 'src/R1/n1.py' AND name LIKE '%.s%'").select("id")
    base = n.where("type = 'class' AND name LIKE 'R%'")
    fresh = base.select(N.node_id(F.col("file_path"), F.lit("function"), F.lit("fresh_helper")).alias("id"), F.lit("function").alias("type"), F.lit("fresh_helper").alias("name"), "file_path", F.lit(99).cast("bigint").alias("line_start"))
    edge = lambda df, a, b: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit("calls").alias("edge_type"), F.lit("high").alias("confidence"))
    used = base.where("name IN ('R0', 'R2', 'R4')").select("id", N.node_id(F.col("file_path"), F.lit("function"), F.lit("fresh_helper")).alias("helper"))
    turned = e.where("edge_type = 'inherits'").join(n.where("name IN ('N0', 'N9')").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    kept = e
    for end in ("source_id", "target_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    new = kept.select(*e.columns).unionByName(edge(used, "id", "helper")).unionByName(edge(turned, "target_id", "source_id"))
    after = mutate.Graph(n.join(gone, "id", "left_anti").select(*n.columns).unionByName(fresh), shared_table(new, "graph"))
    return alerts.change_alerts(mutate.Graph(n, e), after)


@query(
    """WITH x AS (SELECT s.id AS sid, t.id AS tid FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE s.file_path <> t.file_path)
SELECT file_path, name, type, line_start, (SELECT count(*) FROM x WHERE tid = id) AS n_cross_callers, (SELECT count(*) FROM x WHERE sid = id) AS n_cross_callees FROM nodes""",
    G,
)
def cross_counts(spark, sf):
    return context.cross_counts(*_graph(spark, sf))


@query(
    """WITH near AS (SELECT source_id AS id, coalesce(t.name, target_id) || '|' || coalesce(t.file_path, '') || '|' || edge_type AS item, 'out' AS side FROM edges LEFT JOIN nodes t ON t.id = target_id
UNION ALL SELECT target_id, coalesce(s.name, source_id) || '|' || coalesce(s.file_path, '') || '|' || edge_type, 'in' FROM edges LEFT JOIN nodes s ON s.id = source_id),
lists AS (SELECT id, string_agg(item, ';' ORDER BY item) FILTER (side = 'out') AS calls_out, string_agg(item, ';' ORDER BY item) FILTER (side = 'in') AS called_by FROM near GROUP BY id)
SELECT file_path, name AS entity, type, line_start, coalesce(calls_out, '') AS calls_out, coalesce(called_by, '') AS called_by FROM nodes LEFT JOIN lists USING (id)""",
    G,
)
def file_context(spark, sf):
    """The nested lists, written out in the order of their texts."""
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("|", x["name"], x["file_path"], x["edge_type"]))), ";"), F.lit("")).alias(c)
    c = context.file_context(*_graph(spark, sf))
    return c.select("file_path", "entity", "type", "line_start", listed("calls_out"), listed("called_by"))


@query(
    """WITH x AS (SELECT target_id AS id, count(*) AS n FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE s.file_path <> t.file_path GROUP BY 1),
r AS (SELECT file_path, name, type, line_start, coalesce(n, 0) AS n_cross_callers, row_number() OVER (PARTITION BY file_path ORDER BY CASE type WHEN 'class' THEN 0 ELSE 1 END, coalesce(n, 0) DESC, line_start, name) AS place FROM nodes LEFT JOIN x USING (id))
SELECT * FROM r WHERE place <= 5""",
    G,
)
def key_entities(spark, sf):
    return context.key_entities(*_graph(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query(
    """WITH f AS (SELECT DISTINCT target_file AS t, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(source_file, '([^/]*)$', 1) AS base FROM fe),
g AS (SELECT t, folder, count(*) AS n, list_sort(list(base)) AS bases FROM f GROUP BY 1, 2), e AS (SELECT t, unnest(CASE WHEN n >= 3 AND folder <> '' THEN [folder || '/ (' || n || ' files)'] ELSE bases END) AS entry FROM g),
l AS (SELECT t, list_sort(list(entry)) AS entries FROM e GROUP BY 1)
SELECT t AS target_file, CASE WHEN len(entries) <= 5 THEN array_to_string(entries, ', ') ELSE array_to_string(entries[:4], ', ') || ' +' || (len(entries) - 4) || ' more' END AS listed FROM l""",
    G,
)
def affected_grouping(spark, sf):
    f = _file_graph(spark, sf).select("target_file", F.col("source_file").alias("file_path"))
    return context.affected_grouping(f, "target_file")


@query("SELECT DISTINCT translate(source_file, './- ', '____') || ' --> ' || translate(target_file, './- ', '____') AS line FROM fe", G)
def diagram_edges(spark, sf):
    return context.diagram_edges(_file_graph(spark, sf))


# --- questions -----------------------------------------------------------------------------------

_QUESTIONS = [
    "Who calls parse_file?", "callers of Graph.add", "what does main call?", "reverse dependencies of core.py", "what depends on util", "dependencies of api.py", "impact of changing validate",
    "find dead code", "circular dependencies", "any cycles?", "path from A to B", "how is A connected to C", "find functions named foo", "architecture overview", "diagram of core", "describe the Engine",
    "what does api export", "make me a sandwich", "who uses the", "Where is Widget used",
]


def _values(items: list[str]) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))


def _route_sql() -> str:
    whens, args = [], []
    for c, p, n in router.ROUTES:
        sql = p.replace("'", "''")
        found = "trim(" + " || ' ' || ".join(f"regexp_extract(t, '(?i){sql}', {i + 1})" for i in range(n)) + ")" if n else "''"
        hit = f"regexp_matches(t, '(?i){sql}')" + (f" AND lower({found}) NOT IN ({', '.join(repr(w) for w in router.NO_NAMES)})" if n == 1 else "")
        whens.append(f"WHEN {hit} THEN '{c}'")
        args.append(f"WHEN {hit} THEN {found}")
    return f"WITH q(k, question) AS (VALUES {_values(_QUESTIONS)}), x AS (SELECT *, regexp_replace(trim(question), '\\?+$', '') AS t FROM q) SELECT k, question, CASE {' '.join(whens)} END AS command, CASE {' '.join(args)} END AS args FROM x"


@query(_route_sql())
def route_questions(spark, sf):
    q = spark.createDataFrame(list(enumerate(_QUESTIONS)), "k int, question string")
    return router.route_questions(q)


_PATTERNS = ["parse_file(", "from core import x", "import os", "def handle", "class Engine", "MAX_SIZE(", "x(", "foo.*bar", "def f", "callIt ("]


@query(
    f"""WITH q(k, pattern) AS (VALUES {_values(_PATTERNS)}), x AS (SELECT *, regexp_extract(pattern, '^(\\w+)\\s*\\\\?\\(', 1) AS a, regexp_extract(pattern, '^(?:from|import)\\s+(\\S+)', 1) AS b, regexp_extract(pattern, '^(?:def|class)\\s+(\\w+)', 1) AS c FROM q),
y AS (SELECT k, pattern, CASE WHEN length(a) >= 2 AND NOT (upper(a) = a AND length(a) > 2) THEN 'callers' WHEN length(b) >= 2 AND NOT (upper(b) = b AND length(b) > 2) THEN 'rdeps' WHEN length(c) >= 2 AND NOT (upper(c) = c AND length(c) > 2) THEN 'entity' END AS command, a, b, c FROM x)
SELECT k, pattern, command, CASE command WHEN 'callers' THEN a WHEN 'rdeps' THEN b WHEN 'entity' THEN c END AS name FROM y"""
)
def classify_grep(spark, sf):
    return router.classify_greps(spark.createDataFrame(list(enumerate(_PATTERNS)), "k int, pattern string"))


# --- extraction, folds and streams: beyond SQL, tested against facts and plain versions -----------


def _sources(spark, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "file_path string, content string")


def _facts(entities: DataFrame) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    imports = F.array_join(F.transform("imports", lambda i: F.concat(i["module"], F.lit(":"), i["name"])), ",").alias("imports")
    return entities.select("file_path", "entity_type", "name", "line_start", "line_end", listed("calls"), listed("inherits"), imports, listed("type_refs"), listed("decorators"))


@query(generated.PYTHON_SQL)
def extract_python(spark, sf):
    """A Python file for each part; the facts are worked out by hand."""
    return _facts(extract.extract_entities(generated.files(spark, sf, generated.PYTHON)))


@query(generated.LANGUAGES_SQL)
def extract_regex_family(spark, sf):
    """A file in each of the other six languages for each part."""
    return _facts(extract.extract_entities(generated.language_files(spark, sf)))


@query()
def partial_parse(spark, sf):
    return extract.parse_regions(_sources(spark, samples.BROKEN)).withColumn("names", F.array_join("names", ","))


@query(generated.SCOPES_SQL)
def semantic_paths(spark, sf):
    out = extract.semantic_paths(generated.files(spark, sf, generated.PYTHON))
    return out.select("file_path", "entity_type", F.array_join("scope_chain", ".").alias("scope_chain"), "name", "line_start", "line_end")


@query(generated.EDGES_SQL)
def project_graph(spark, sf):
    """A project of a module for each part, from sources to edges: extraction, then the resolution cascade."""
    n = shared_table(changes.project_nodes(generated.files(spark, sf, generated.MODULE, once=True)), "nodes")
    return changes.named_edges(n).select("source", "edge_type", "target", "target_file", "confidence")


def _keys(spark, sf) -> DataFrame:
    """Each turn of a conversation typed character by character, 40 ms apart, with pauses at spaces and lines."""
    c = V.table(spark, sf, "conversations").where("text IS NOT NULL AND text <> ''")
    k = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("session"), F.posexplode(F.split("text", "")).alias("seq", "ch")).where("ch <> ''")
    pause = F.when(F.col("ch") == " ", 90).when(F.col("ch") == "\n", 260).otherwise(40)
    return k.select("session", F.col("seq").cast("bigint").alias("seq"), "ch", (F.col("seq") * 40 + F.when(F.col("seq") % 17 == 0, pause).otherwise(0)).cast("double").alias("ms"))


@query()
def debounce_full(spark, sf):
    t = keystrokes.tiers(_keys(spark, sf))
    return t.groupBy("session", "tier").agg(F.count("*").alias("n"))


@query()
def stable_context(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60
    r = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"), at.alias("ms"), F.lit(0.8).alias("confidence"))
    return keystrokes.stable_context(r)


@query("SELECT CAST(user_id AS VARCHAR) AS file, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file"))
    return windows.tumbling(e, "1 day", by="file").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT file, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ts) AS k FROM e)
SELECT file, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY file, k"""
)
def stream_session_window(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file"))
    w = windows.sessions(e, "6 hours")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query()
def stream_changes(spark, sf):
    """The change pipeline over two batches of the sample project: the operations it logs."""
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/changes-{uuid.uuid4().hex}"
    p = changes.ChangePipeline(spark, at)
    first = _sources(spark, samples.FILES).select("file_path", F.lit(0).cast("bigint").alias("seq"), "content")
    edited = {k: v.replace("def total(", "def sum_up(").replace("RATE = 0.2", "RATE = 0.3") for k, v in samples.FILES.items()}
    p.process(first, 0)
    p.process(_sources(spark, edited).select("file_path", F.lit(1).cast("bigint").alias("seq"), "content"), 1)
    return p.ops().select("batch", "file_path", "seq", "op_type", "name", "old_name", "place")
