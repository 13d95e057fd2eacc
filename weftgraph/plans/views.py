"""The graph, change stream, log and module views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import node_id
from ..operators.versioning import numbered

#: The same views as DuckDB common table expressions.
GRAPH_SQL = """
n0 AS (
  SELECT 'class' AS type, 'R' || r_regionkey AS name, 'src/R' || r_regionkey || '/base.py' AS file_path, 1 AS line_start FROM region
  UNION ALL SELECT 'class', 'N' || n_nationkey, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py', 1 FROM nation
  UNION ALL SELECT 'function', 'N' || n_nationkey || '.c' || c_custkey, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py', 2 * c_custkey + 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'function', 'N' || n_nationkey || '.s' || s_suppkey, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py', 2 * s_suppkey + 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'variable', 'p' || p_partkey, 'lib/' || p_brand || '.py', p_partkey + 1 FROM part),
nodes AS (SELECT left(sha256(file_path || ':' || type || ':' || name), 16) AS id, type, name, file_path, CAST(line_start AS BIGINT) AS line_start FROM n0),
cust AS (SELECT c_custkey, 'N' || n_nationkey || '.c' || c_custkey AS cname, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py' AS cfile, n_nationkey AS cn, n_regionkey AS cr FROM customer JOIN nation ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey, 'N' || n_nationkey || '.s' || s_suppkey AS sname, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py' AS sfile FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lines AS (SELECT o_custkey, l_suppkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e0 AS (
  SELECT cfile || ':function:' || cname AS s, sfile || ':function:' || sname AS t, 'calls' AS edge_type, n FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lines GROUP BY ALL) JOIN cust ON o_custkey = c_custkey JOIN supp ON l_suppkey = s_suppkey
  UNION ALL SELECT cfile || ':function:' || cname, 'lib/' || p_brand || '.py:variable:p' || p_partkey, 'imports', n FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM lines GROUP BY ALL) JOIN cust ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'src/R' || n_regionkey || '/n' || n_nationkey || '.py:function:N' || n_nationkey || '.s' || s_suppkey, 'src/R' || n_regionkey || '/n' || n_nationkey || '.py:class:N' || n_nationkey, 'uses_type', 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'src/R' || n_regionkey || '/n' || n_nationkey || '.py:class:N' || n_nationkey, 'src/R' || r_regionkey || '/base.py:class:R' || r_regionkey, 'inherits', 3 FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (SELECT left(sha256(s), 16) AS source_id, left(sha256(t), 16) AS target_id, edge_type, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence FROM e0),
fe AS (SELECT a.file_path AS source_file, b.file_path AS target_file, edge_type, count(*) AS n FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.file_path <> b.file_path GROUP BY ALL)
"""

CHANGES_SQL = r"""
versions AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, turn AS seq, coalesce(text, '') AS body FROM conversations),
lines0 AS (SELECT file_path, seq, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS ord FROM versions),
lines1 AS (SELECT file_path, seq, CAST(ord AS BIGINT) AS ord, line, string_split(line, ' ')[1] AS name FROM lines0 WHERE string_split(line, ' ')[1] <> ''),
entities AS (SELECT file_path, seq, name, 'function' AS type, left(sha256(line), 12) AS sig, CAST(length(line) - length(replace(line, ' ', '')) AS BIGINT) AS struct, ord AS line_start, ord AS line_end, ord FROM lines1)
"""

LOG_SQL = """
log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS version, ts, CAST(user_id AS VARCHAR) AS file, event_type, event_id, value,
  CASE event_type WHEN 'signup' THEN 'add_node' WHEN 'error' THEN 'remove_node' ELSE 'update_node' END AS op_type,
  'e' || CAST(floor(value) AS BIGINT) AS node_id,
  CASE WHEN event_type = 'purchase' THEN 'old' || CAST(user_id AS VARCHAR) END AS renamed_from FROM events)
"""

IMPORTS_SQL = r"""
site AS (SELECT page_id AS ord, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS file_path, html FROM pages),
links AS (SELECT ord, file_path, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM site)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_file() -> F.Column:
    return F.concat(F.lit("src/R"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit(".py"))


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as functions of their nation's file."""
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda p, k: F.concat(F.lit("N"), F.col("n_nationkey"), F.lit(f".{p}"), F.col(k)).alias("name")
    c = c.select("c_custkey", name("c", "c_custkey"), _nation_file().alias("file_path"))
    s = s.select("s_suppkey", name("s", "s_suppkey"), _nation_file().alias("file_path"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("class_name"))
    return c, s


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, file_path, line_start): regions and nations are classes, customers and suppliers functions, parts variables."""
    region, nation, part = (table(spark, sf_dir, t) for t in ("region", "nation", "part"))
    c, s = _members(spark, sf_dir)
    row = lambda df, kind, name, path, line: df.select(F.lit(kind).alias("type"), name.alias("name"), path.alias("file_path"), line.cast("bigint").alias("line_start"))
    r = F.concat(F.lit("R"), F.col("r_regionkey"))
    all_ = (
        row(region, "class", r, F.concat(F.lit("src/"), r, F.lit("/base.py")), F.lit(1))
        .unionByName(row(nation, "class", F.concat(F.lit("N"), F.col("n_nationkey")), _nation_file(), F.lit(1)))
        .unionByName(row(c, "function", F.col("name"), F.col("file_path"), 2 * F.col("c_custkey") + 2))
        .unionByName(row(s, "function", F.col("name"), F.col("file_path"), 2 * F.col("s_suppkey") + 3))
        .unionByName(row(part, "variable", F.concat(F.lit("p"), F.col("p_partkey")), F.concat(F.lit("lib/"), F.col("p_brand"), F.lit(".py")), F.col("p_partkey") + 1))
    )
    return all_.select(node_id(F.col("file_path"), F.col("type"), F.col("name")).alias("id"), "type", "name", "file_path", "line_start")


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(source_id, target_id, edge_type, confidence); only ``kinds`` if given, so that no other is computed.

    Order lines are counted by their keys before any name is built, so that the large tables shuffle
    numbers alone.
    """
    c, s = _members(spark, sf_dir)
    c = c.select("c_custkey", node_id(F.col("file_path"), F.lit("function"), F.col("name")).alias("source_id"))
    sid = s.select("s_suppkey", node_id(F.col("file_path"), F.lit("function"), F.col("name")).alias("target_id"))
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    lines = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = []
    if not kinds or "calls" in kinds:
        n = lines.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
        out.append(n.join(c, F.col("o_custkey") == F.col("c_custkey")).join(sid, F.col("l_suppkey") == F.col("s_suppkey")).select("source_id", "target_id", F.lit("calls").alias("edge_type"), "n"))
    if not kinds or "imports" in kinds:
        p = table(spark, sf_dir, "part").select("p_partkey", node_id(F.concat(F.lit("lib/"), F.col("p_brand"), F.lit(".py")), F.lit("variable"), F.concat(F.lit("p"), F.col("p_partkey"))).alias("target_id"))
        n = lines.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
        out.append(n.join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("source_id", "target_id", F.lit("imports").alias("edge_type"), "n"))
    if not kinds or "uses_type" in kinds:
        out.append(s.select(node_id(F.col("file_path"), F.lit("function"), F.col("name")).alias("source_id"), node_id(F.col("file_path"), F.lit("class"), F.col("class_name")).alias("target_id"), F.lit("uses_type").alias("edge_type"), F.lit(3).cast("bigint").alias("n")))
    if not kinds or "inherits" in kinds:
        r = F.concat(F.lit("R"), F.col("n_regionkey"))
        n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
        out.append(n.select(node_id(_nation_file(), F.lit("class"), F.concat(F.lit("N"), F.col("n_nationkey"))).alias("source_id"), node_id(F.concat(F.lit("src/"), r, F.lit("/base.py")), F.lit("class"), r).alias("target_id"), F.lit("inherits").alias("edge_type"), F.lit(3).cast("bigint").alias("n")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.select("source_id", "target_id", "edge_type", F.when(F.col("n") >= 3, "high").when(F.col("n") == 2, "medium").otherwise("low").alias("confidence"))


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Versions (file_path, seq, blank) and their entities: turns of a conversation, and their lines."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("body"))
    versions = c.select("file_path", "seq", (F.trim("body") == "").alias("blank"))
    e = c.select("file_path", "seq", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    e = e.select("file_path", "seq", (F.col("pos") + 1).cast("bigint").alias("ord"), "line", F.split("line", " ")[0].alias("name")).where("name <> ''")
    spaces = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))).cast("bigint")
    return versions, e.select("file_path", "seq", "name", F.lit("function").alias("type"), F.left(F.sha2("line", 256), F.lit(12)).alias("sig"), spaces.alias("struct"), F.col("ord").alias("line_start"), F.col("ord").alias("line_end"), "ord")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, ts, file, event_type, event_id, value, op_type, node_id, renamed_from) of events, numbered by time."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("file"), "event_type", "value")
    op = F.when(F.col("event_type") == "signup", "add_node").when(F.col("event_type") == "error", "remove_node").otherwise("update_node")
    e = e.withColumn("op_type", op).withColumn("node_id", F.concat(F.lit("e"), F.floor("value").cast("bigint")))
    e = e.withColumn("renamed_from", F.when(F.col("event_type") == "purchase", F.concat(F.lit("old"), "file")))
    return numbered(e, ["ts", "event_id"])


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("file_path"), "html")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, file_path, target): links of a page, as imports."""
    return site(spark, sf_dir).select("ord", "file_path", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
