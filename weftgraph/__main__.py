"""Command line: build a project's graph, query it, or serve it.

    python -m weftgraph --state DIR --project PATH build
    python -m weftgraph --state DIR --project PATH callers parse_file
    python -m weftgraph --state DIR --project PATH ask "what depends on core.py?"
    python -m weftgraph --state DIR --project PATH serve | ping | shutdown

A query goes to the project's service if one answers, else to a session of its own.
"""

from __future__ import annotations

import argparse
import json
import sys

from .engine import Engine
from .service import Service, StatePaths, alive, request
from .sources import store

QUERIES = "callers callees deps rdeps file entity impact dead cycles path search exports summary stats visualize".split()


def _session():
    from pyspark.sql import SparkSession

    from .session import local_session

    return SparkSession.getActiveSession() or local_session()


def build(paths: StatePaths) -> str:
    """Scan the project and store its graph; returns its description."""
    from .operators.mutate import Graph
    from .session import on_workers, shared_table
    from .sources.projects import scan_files
    from .streaming.changes import edges_of, entities_of, nodes_of

    spark = _session()
    on_workers(spark)
    files = scan_files(spark, f"file://{paths.project}").selectExpr("file_path", "0L AS seq", "content")
    nodes = shared_table(nodes_of(entities_of(files)), "nodes")
    at = store.save(Graph(nodes, edges_of(nodes)), paths.graph)
    return f"{at}: {store.describe(store.load(spark, paths.graph))}"


def run(args: list[str]) -> tuple[int, str]:
    """Exit code and text of a command line."""
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--project", default=".")
    p.add_argument("--state", required=True, help="folder of the projects' graphs and services")
    p.add_argument("--json", action="store_true", help="rows as JSON instead of text")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("command", choices=[*QUERIES, "ask", "build", "serve", "ping", "shutdown"])
    p.add_argument("args", nargs="*")
    o = p.parse_args(args)
    paths = StatePaths(o.project, o.state)
    if o.command == "build":
        return 0, build(paths)
    if o.command in ("ping", "shutdown"):
        said = request(paths, {"command": o.command})
        return (0 if said["ok"] else 1), json.dumps(said, sort_keys=True)
    if o.command == "serve":
        service = Service(paths, store.load(_session(), paths.graph))
        service.start()
        service.wait()
        return 0, "stopped"
    body = {"question": " ".join(o.args)} if o.command == "ask" else {"command": o.command, "args": o.args}
    body["limit"] = o.limit
    try:
        said = request(paths, body) if alive(paths) else Engine(store.load(_session(), paths.graph)).handle(body)
    except store.StoreError as e:
        said = {"ok": False, "error": str(e)}
    if not said["ok"]:
        return 1, said["error"]
    if o.json:
        return 0, json.dumps(said["rows"], default=str)
    return 0, "\n".join("  ".join("" if v is None else str(v) for v in r.values()) for r in said["rows"]) or "nothing found"


def main() -> int:
    code, text = run(sys.argv[1:])
    print(text, file=sys.stderr if code else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
