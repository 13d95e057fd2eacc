"""Source files written from the driver's ``part`` table, and SQL for the facts that extraction must find in them.

Each part is a file in each language; its key, brand, size and key modulo 7 stand for {k}, {b}, {s}
and {h} in a template. The facts are written down by hand, a row for each entity of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BRACES = {
    "ts": ("lib/p{k}.ts", """import { base } from './lib{b}';

export class P{k} extends Base{b} {
  price(q: Money) {
    return rate_{s}(q);
  }
}

function make_{k}(n) {
  return helper_{h}(n);
}
"""),
    "js": ("lib/p{k}.js", """import { base } from './lib{b}';

export class P{k} extends Base{b} {
  price(q) {
    // helper_9(q) is not called here
    return rate_{s}(q);
  }
}
"""),
    "rs": ("lib/p{k}.rs", """use crate::lib::base;

struct P{k} {
    size: u32,
}

fn make_{k}(n: u32) -> u32 {
    helper_{h}(n)
}
"""),
    "cpp": ("lib/p{k}.cpp", """#include "lib{b}.h"

class P{k} : public Base{b} {
  int price(int q) {
    return rate_{s}(q);
  }
};

int make_{k}(int n) {
  return helper_{h}(n);
}
"""),
    "c": ("lib/p{k}.c", """#include "lib{b}.h"

struct P{k} {
  int size;
};

int make_{k}(int n) {
  return helper_{h}(n);
}
"""),
    "java": ("lib/P{k}.java", """import lib.{b}.Base;

public class P{k} extends Base{b} {
  public int price(Money q) {
    return rate_{s}(q);
  }
}
"""),
}
PYTHON = ("lib/p{k}.py", """import os
from lib.{b} import base as b{k}

LIMIT = {s}

class P{k}(Base{b}):
    @cached
    def price(self, q: Money) -> Total:
        return self.scale(q) + rate_{s}(LIMIT) + len(os.path.join("a", "b"))

async def make_{k}(n: int):
    return P{k}(helper_{h}(n))

start_{k}()
""")
#: A project of modules: each imports from the one of half its key, whose function it calls.
MODULE = ("lib/m{k}.py", """from lib.m{j} import make_{j}

class C{k}(C{i}):
    def run_{k}(self, n):
        return make_{j}(n)

def make_{k}(n: C{k}):
    return self_{k}(n)

def walk_{k}(c: C{k}):
    return c.run_{k}(1)
""")
# (entity type, name, first line, last line, calls, bases, imports, type references, decorators)
PYTHON_FACTS = [
    ("import", "os", 1, 1, "", "", ":os", "", ""),
    ("import", "b{k}", 2, 2, "", "", "lib.{b}:base", "", ""),
    ("variable", "LIMIT", 4, 4, "", "", "", "", ""),
    ("class", "P{k}", 6, 9, "rate_{s},scale", "Base{b}", "", "", ""),
    ("function", "P{k}.price", 8, 9, "P{k}.scale,rate_{s}", "", "", "Money,Total", "cached"),
    ("function", "make_{k}", 11, 12, "P{k},helper_{h}", "", "", "", ""),
    ("module_code", "__module__", 1, 14, "start_{k}", "", "", "", ""),
]
FACTS = {
    "ts": [("import", "base", 1, 1, "", "", "./lib{b}:base", "", ""), ("class", "P{k}", 3, 7, "price,rate_{s}", "Base{b}", "", "Money", ""), ("function", "P{k}.price", 4, 6, "rate_{s}", "", "", "Money", ""), ("function", "make_{k}", 9, 11, "helper_{h}", "", "", "", "")],
    "js": [("import", "base", 1, 1, "", "", "./lib{b}:base", "", ""), ("class", "P{k}", 3, 8, "price,rate_{s}", "Base{b}", "", "", ""), ("function", "P{k}.price", 4, 7, "rate_{s}", "", "", "", "")],
    "rs": [("import", "base", 1, 1, "", "", "crate::lib:base", "", ""), ("class", "P{k}", 3, 5, "", "", "", "", ""), ("function", "make_{k}", 7, 9, "helper_{h}", "", "", "", "")],
    "cpp": [("import", "lib{b}.h", 1, 1, "", "", ".:lib{b}.h", "", ""), ("class", "P{k}", 3, 7, "price,rate_{s}", "Base{b}", "", "", ""), ("function", "P{k}.price", 4, 6, "rate_{s}", "", "", "", ""), ("function", "make_{k}", 9, 11, "helper_{h}", "", "", "", "")],
    "c": [("import", "lib{b}.h", 1, 1, "", "", ".:lib{b}.h", "", ""), ("class", "P{k}", 3, 5, "", "", "", "", ""), ("function", "make_{k}", 7, 9, "helper_{h}", "", "", "", "")],
    "java": [("import", "Base", 1, 1, "", "", "lib.{b}:Base", "", ""), ("class", "P{k}", 3, 7, "price,rate_{s}", "Base{b}", "", "", ""), ("function", "P{k}.price", 4, 6, "rate_{s}", "", "", "", "")],
}
#: Scopes of PYTHON: (kind, chain, name, first line, last line).
SCOPES = [
    ("import", "", "os", 1, 1), ("import", "", "b{k}", 2, 2), ("variable", "", "LIMIT", 4, 4), ("class", "", "P{k}", 6, 9), ("function", "P{k}", "price", 8, 9),
    ("parameter", "P{k}.price", "self", 8, 8), ("parameter", "P{k}.price", "q", 8, 8), ("function", "", "make_{k}", 11, 12), ("parameter", "make_{k}", "n", 11, 11),
]
_COLUMNS = "entity_type, name, line_start, line_end, calls, inherits, imports, type_refs, decorators"


def _filled(template: str, of: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in of.items():
        if "{" + name + "}" not in template:
            continue
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def files(spark: SparkSession, sf: str, *templates: tuple[str, str], once: bool = False) -> DataFrame:
    """(file_path, content) of every part in each of ``templates``.

    A part is a short row and its files are much work: the rows are dealt out evenly, as a table of
    many parts may be one row group and hence one task. ``once`` takes one part of each key.
    """
    p, n = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size"), 4 * spark.sparkContext.defaultParallelism
    p = p.repartition(n, "p_partkey").dropDuplicates(["p_partkey"]) if once else p.repartition(n)
    k = F.col("p_partkey")
    of = {"k": k, "b": F.replace("p_brand", F.lit("#"), F.lit("")), "s": F.col("p_size"), "h": k % 7, "j": F.expr("p_partkey div 2"), "i": k % 5}
    made = F.explode(F.array(*[F.struct(_filled(path, of).alias("file_path"), _filled(text, of).alias("content")) for path, text in templates]))
    return p.select(made.alias("f")).select("f.*")


def language_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, *_BRACES.values())


def facts_sql(facts: dict[str, list[tuple]], paths: dict[str, str], columns: str = _COLUMNS) -> str:
    """The facts of every part's files, in DuckDB's SQL."""
    rows = ",\n".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in (paths[lang], *fact)) + ")" for lang, x in facts.items() for fact in x)
    names = columns.split(", ")
    fill = lambda c: c if c.startswith("line_") else f"replace(replace(replace(replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{b}}', replace(p_brand, '#', '')), '{{s}}', CAST(p_size AS VARCHAR)), '{{h}}', CAST(p_partkey % 7 AS VARCHAR)) AS {c}"
    return f"SELECT {', '.join(map(fill, ['file_path', *names]))} FROM part, (VALUES\n{rows}\n) AS f(file_path, {columns})"


PATHS = {lang: path for lang, (path, _) in _BRACES.items()}
PYTHON_SQL = facts_sql({"py": PYTHON_FACTS}, {"py": PYTHON[0]})
LANGUAGES_SQL = facts_sql(FACTS, PATHS)
SCOPES_SQL = facts_sql({"py": SCOPES}, {"py": PYTHON[0]}, "entity_type, scope_chain, name, line_start, line_end")
#: The edges of the project of modules, worked out from the keys alone.
EDGES_SQL = """
WITH m AS (SELECT p_partkey AS k, p_partkey // 2 AS j, p_partkey % 5 AS i FROM part),
e AS (
  SELECT 'make_' || j AS source, 'imports' AS edge_type, 'make_' || j AS target, 'lib/m' || j || '.py' AS target_file, 'high' AS confidence, k FROM m
  UNION ALL SELECT 'C' || k, 'calls', 'make_' || j, 'lib/m' || j || '.py', CASE WHEN k = 0 THEN 'medium' ELSE 'high' END, k FROM m
  UNION ALL SELECT 'C' || k || '.run_' || k, 'calls', 'make_' || j, 'lib/m' || j || '.py', CASE WHEN k = 0 THEN 'medium' ELSE 'high' END, k FROM m
  UNION ALL SELECT 'C' || k, 'inherits', 'C' || i, 'lib/m' || i || '.py', CASE WHEN i = j THEN 'high' ELSE 'medium' END, k FROM m WHERE i <> k
  UNION ALL SELECT 'make_' || k, 'uses_type', 'C' || k, 'lib/m' || k || '.py', 'medium', k FROM m
  UNION ALL SELECT 'walk_' || k, 'uses_type', 'C' || k, 'lib/m' || k || '.py', 'medium', k FROM m
  UNION ALL SELECT 'walk_' || k, 'calls', 'C' || k || '.run_' || k, 'lib/m' || k || '.py', 'high', k FROM m)
SELECT source, edge_type, target, target_file, confidence FROM e"""
