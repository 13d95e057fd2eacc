"""A long-lived session that answers requests over a local socket, its client, and its state files.

Requests and answers are JSON documents, a line each. The service answers ``ping`` and ``shutdown``
itself and hands everything else to the engine.
"""

from __future__ import annotations

import json
import os
import socket
import socketserver
import threading
from dataclasses import dataclass, field
from pathlib import Path

from .engine import Engine
from .operators.mutate import Graph
from .sources import store

MAX_REQUEST = 1 << 20


@dataclass(frozen=True)
class StatePaths:
    """Where a project's service keeps its socket, its process number and its graph."""

    project: str
    base: str

    @property
    def folder(self) -> Path:
        return Path(self.base) / store.project_key(self.project)

    @property
    def socket(self) -> Path:
        return self.folder / "service.sock"

    @property
    def pid(self) -> Path:
        return self.folder / "service.pid"

    @property
    def graph(self) -> str:
        return f"file://{self.folder / 'graph'}"


def owner(paths: StatePaths) -> int | None:
    """The process number in the state folder if that process lives, else None."""
    try:
        pid = int(paths.pid.read_text())
        os.kill(pid, 0)
    except PermissionError:
        return pid  # it lives, under another user
    except (OSError, ValueError):
        return None
    return pid


def clear_stale(paths: StatePaths) -> bool:
    """Remove the socket and number that a dead service left; False if it lives."""
    if owner(paths) is not None:
        return False
    for p in (paths.socket, paths.pid):
        p.unlink(missing_ok=True)
    return True


def request(paths: StatePaths, body: dict, timeout: float = 30.0) -> dict:
    """One request to a service; ``{"ok": False}`` with the reason if none answers."""
    try:
        with socket.socket(socket.AF_UNIX) as s:
            s.settimeout(timeout)
            s.connect(str(paths.socket))
            s.sendall(json.dumps(body).encode() + b"\n")
            with s.makefile("rb") as answer:
                line = answer.readline()
    except OSError as e:
        return {"ok": False, "error": f"no service: {e}"}
    return json.loads(line) if line else {"ok": False, "error": "no answer"}


def alive(paths: StatePaths, timeout: float = 2.0) -> bool:
    return request(paths, {"command": "ping"}, timeout).get("ok", False)


@dataclass
class Service:
    """Serves one graph; ``replace`` swaps it, and a changed graph is saved at shutdown and every ``save_every`` seconds."""

    paths: StatePaths
    graph: Graph
    save_every: float = 60.0
    dirty: bool = False
    _server: socketserver.ThreadingUnixStreamServer | None = None
    _stopped: threading.Event = field(default_factory=threading.Event)
    _done: threading.Event = field(default_factory=threading.Event)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def replace(self, graph: Graph) -> None:
        with self._lock:
            self.graph, self.dirty = graph, True

    def save(self) -> None:
        with self._lock:
            graph, changed, self.dirty = self.graph, self.dirty, False
        if not changed:
            return
        try:
            store.save(graph, self.paths.graph)
        except Exception:
            self.dirty = True  # the next round tries again
            raise

    def answer(self, body: dict) -> dict:
        match body.get("command"):
            case "ping":
                return {"ok": True, "nodes": self.graph.nodes.count(), "edges": self.graph.edges.count()}
            case "shutdown":
                threading.Thread(target=self.stop, daemon=True).start()
                return {"ok": True}
            case _:
                return Engine(self.graph).handle(body)

    def _line(self, line: bytes) -> dict:
        try:
            body = json.loads(line)
        except ValueError:
            return {"ok": False, "error": "a request is one JSON document in a line"}
        if not isinstance(body, dict):
            return {"ok": False, "error": "a request is a JSON object"}
        try:
            return self.answer(body)
        except Exception as e:  # a failed query must not end the service
            return {"ok": False, "error": f"{type(e).__name__}: {str(e)[:500]}"}

    def start(self) -> None:
        """Serve in threads of this process; refuses where another service lives."""
        if not clear_stale(self.paths):
            raise RuntimeError(f"process {owner(self.paths)} serves this project")
        self.paths.folder.mkdir(parents=True, exist_ok=True)
        service = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                line = self.rfile.readline(MAX_REQUEST)
                self.wfile.write(json.dumps(service._line(line), default=str).encode() + b"\n")

        self._server = socketserver.ThreadingUnixStreamServer(str(self.paths.socket), Handler)
        self._server.daemon_threads = True
        self.paths.pid.write_text(str(os.getpid()))
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        threading.Thread(target=self._save_regularly, daemon=True).start()

    def _save_regularly(self) -> None:
        while not self._stopped.wait(self.save_every):
            try:
                self.save()
            except Exception as e:
                print(f"graph not saved: {e}")

    def stop(self) -> None:
        """Save what changed, take no more requests and remove the state files."""
        if self._stopped.is_set():
            return
        self._stopped.set()
        try:
            self.save()
        finally:
            if self._server:
                self._server.shutdown()
                self._server.server_close()
            for p in (self.paths.socket, self.paths.pid):
                p.unlink(missing_ok=True)
            self._done.set()

    def wait(self) -> None:
        """Until all is saved and removed."""
        self._done.wait()
