"""The command line and the service, over a project of two files."""

from __future__ import annotations

import json
import os

import pytest

from weftgraph.__main__ import run
from weftgraph.operators.mutate import Graph
from weftgraph.service import Service, StatePaths, alive, clear_stale, request
from weftgraph.sources import store


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    (at / "core.py").write_text("def area(r):\n    return r * r\n\n\ndef spare():\n    return 0\n")
    (at / "app.py").write_text("from core import area\n\n\ndef main():\n    return area(2)\n")
    state = str(tmp_path_factory.mktemp("state"))
    code, text = run(["--project", str(at), "--state", state, "build"])
    assert code == 0 and '"nodes"' in text
    return StatePaths(str(at), state)


def line(paths, *args):
    return run(["--project", paths.project, "--state", paths.base, *args])


def test_commands_without_a_service(project):
    code, text = line(project, "callers", "area")
    assert code == 0 and "main" in text
    code, text = line(project, "--json", "ask", "what calls area?")
    assert code == 0 and any(r["name"] == "main" for r in json.loads(text))
    assert line(project, "search", "no_such_name") == (0, "nothing found")
    assert line(project, "ping")[0] == 1
    assert line(StatePaths("/no/such/project", project.base), "stats")[0] == 1


def test_service_answers_and_stops(spark, project):
    service = Service(project, store.load(spark, project.graph))
    service.start()
    try:
        assert alive(project, 60) and not clear_stale(project)
        with pytest.raises(RuntimeError):
            Service(project, service.graph).start()
        said = request(project, {"command": "callers", "args": ["area"]}, 120)
        assert said["ok"] and "main" in {r["name"] for r in said["rows"]}
        assert not request(project, {"command": "none"})["ok"]
        assert not service._line(b"[1]")["ok"] and not service._line(b"{")["ok"]
        n = request(project, {"command": "ping"}, 60)["nodes"]
        service.replace(Graph(service.graph.nodes.where("name <> 'spare'"), service.graph.edges))
        assert request(project, {"command": "shutdown"})["ok"]
        service.wait()
        assert store.load(spark, project.graph).nodes.count() == n - 1
        assert not project.socket.exists() and not project.pid.exists()
    finally:
        service.stop()


def test_stale_state_is_cleared(project):
    project.pid.write_text("999999999")
    project.socket.write_text("")
    assert not alive(project) and clear_stale(project)
    assert not project.socket.exists()
    project.pid.write_text(str(os.getpid()))
    assert not clear_stale(project)
    project.pid.unlink()
