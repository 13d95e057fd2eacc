"""Python sources by their syntax tree."""

from __future__ import annotations

import ast
import sys
from bisect import bisect_right
from collections.abc import Iterator

from ..functions import vocab
from .entity import Entity, short_hash

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# Fields that never hold a node with names or calls below it.
_LEAVES = frozenset("ctx op ops id attr type_comment level module is_async simple conversion asname".split())
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: ()}


def _fields(cls: type) -> tuple[str, ...]:
    """The fields of a node class to go down."""
    if cls not in _FIELDS:
        _FIELDS[cls] = tuple(f for f in cls._fields if f not in _LEAVES)
    return _FIELDS[cls]


def _walk(root: ast.AST) -> list[ast.AST]:
    """As ``ast.walk``, without contexts and operators."""
    out = [root]
    for n in out:
        for f in _fields(type(n)):
            v = getattr(n, f)
            if isinstance(v, list):
                out += [x for x in v if isinstance(x, ast.AST)]
            elif isinstance(v, ast.AST):
                out.append(v)
    return out


def _dump(node: ast.AST, known: dict[int, str]) -> str:
    """``ast.dump``; ``known`` keeps the statements' dumps, so that nested ones are written once."""
    if sys.version_info[:2] != (3, 13):  # what is left out differs
        return ast.dump(node)
    if isinstance(node, ast.stmt) and (found := known.get(id(node))):
        return found
    cls = type(node)
    kept, parts = cls in (ast.Constant, ast.MatchSingleton), []
    for f in cls._fields:
        v = getattr(node, f)
        if isinstance(v, ast.AST):
            parts.append(f"{f}={_dump(v, known)}")
        elif isinstance(v, list):
            if v:
                parts.append(f"{f}=[{', '.join([_dump(x, known) if isinstance(x, ast.AST) else repr(x) for x in v])}]")
        elif v is not None or kept and f == "value":
            parts.append(f"{f}={v!r}")
    out = f"{cls.__name__}({', '.join(parts)})"
    if isinstance(node, ast.stmt):
        known[id(node)] = out
    return out


class _Below:
    """What is below a statement, in walk order."""

    __slots__ = ("assigns", "calls", "loads")

    def __init__(self):
        self.calls: list[ast.Call] = []
        self.loads: list[str] = []
        self.assigns: list[ast.Assign | ast.AnnAssign] = []


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _type_names(node: ast.AST | None) -> Iterator[str]:
    """Project types that an annotation names, quoted ones too."""
    if node is None:
        return
    for n in _walk(node):
        if isinstance(n, ast.Name):
            yield n.id
        elif isinstance(n, ast.Attribute):
            yield n.attr
        elif isinstance(n, ast.Constant) and isinstance(n.value, str):
            try:
                yield from _type_names(ast.parse(n.value, mode="eval").body)
            except (SyntaxError, ValueError):
                continue


def _constructed(node: ast.AST | None) -> str | None:
    """The class that a call constructs, by its capital letter."""
    if isinstance(node, ast.Call) and (name := _dotted(node.func)):
        last = name.split(".")[-1]
        if last[:1].isupper():
            return last
    return None


def _args(a: ast.arguments) -> list[ast.arg]:
    return [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]


class _Module:
    def __init__(self, tree: ast.Module, hashed: bool = True):
        self.tree = tree
        self.hashed = hashed
        self.out: list[Entity] = []
        self.foreign: set[str] = set()  # names that come from modules outside the project
        self.loose = [s for s in tree.body if not isinstance(s, (*FUNCTIONS, ast.ClassDef, ast.Import, ast.ImportFrom))]
        self.below: dict[int, _Below] = {}  # by id: of definitions, and of the statements in ``loose``
        self.dumps: dict[int, str] = {}
        self._read()
        self.types = self._context(tree.body)

    def _read(self) -> None:
        """One walk over the module; walk order below a node is that of the module, without what is elsewhere."""
        self.below = {id(s): _Below() for s in self.loose}
        nodes: list[ast.AST] = list(self.tree.body)
        within: list[tuple[_Below, ...]] = [(b,) if (b := self.below.get(id(s))) else () for s in nodes]
        for n, held in zip(nodes, within, strict=False):  # both grow
            cls = type(n)
            if cls is ast.Name:
                if type(n.ctx) is ast.Load:
                    for b in held:
                        b.loads.append(n.id)
                continue
            if cls is ast.Call:
                for b in held:
                    b.calls.append(n)
            elif cls is ast.Assign or cls is ast.AnnAssign:
                for b in held:
                    b.assigns.append(n)
            elif cls in FUNCTIONS or cls is ast.ClassDef:
                self.below[id(n)] = b = _Below()
                held = (*held, b)
            elif cls is ast.Import:
                self.foreign |= {(a.asname or a.name).split(".")[0] for a in n.names if vocab.is_external(a.name)}
                continue
            elif cls is ast.ImportFrom:
                if n.module and not n.level and vocab.is_external(n.module):
                    self.foreign |= {a.asname or a.name for a in n.names}
                continue
            for f in _FIELDS.get(cls) or _fields(cls):
                v = getattr(n, f)
                if isinstance(v, list):
                    for x in v:
                        if isinstance(x, ast.AST):
                            nodes.append(x)
                            within.append(held)
                elif isinstance(v, ast.AST):
                    nodes.append(v)
                    within.append(held)

    def _context(self, body: list[ast.stmt], args: ast.arguments | None = None, below: _Below | None = None) -> dict[str, str]:
        """Variable -> class, from annotations and constructor calls: of ``below``, statement by statement, or of ``body`` itself."""
        out: dict[str, str] = {}
        for a in _args(args) if args else []:
            for t in _type_names(a.annotation):
                if t not in vocab.PLAIN_TYPES:
                    out[a.arg] = t
                    break
        found = body
        if below:
            starts = [(s.lineno, s.col_offset) for s in body]
            found = sorted(below.assigns, key=lambda n: bisect_right(starts, (n.lineno, n.col_offset)))
        for n in found:
            if isinstance(n, ast.Assign) and (t := _constructed(n.value)):
                out |= {x.id: t for x in n.targets if isinstance(x, ast.Name)}
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                named = next((t for t in _type_names(n.annotation) if t not in vocab.PLAIN_TYPES), None)
                if named:
                    out[n.target.id] = named
        return out

    def calls(self, found: list[ast.Call], scope: str, types: dict[str, str]) -> list[str]:
        """The names of calls, in their order and as often as they occur."""
        out, builtin = [], vocab.builtin_names()
        for n in found:
            f = n.func
            if isinstance(f, ast.Name):
                if f.id not in builtin and f.id not in self.foreign:
                    out.append(f.id)
            elif isinstance(f, ast.Attribute):
                r = f.value.id if isinstance(f.value, ast.Name) else None
                if r in ("self", "cls") and scope:
                    out.append(f"{scope}.{f.attr}")
                elif r in self.foreign:
                    continue
                elif r and (t := types.get(r) or self.types.get(r)):
                    if t not in self.foreign:
                        out.append(f"{t}.{f.attr}")
                elif f.attr not in builtin and f.attr not in vocab.COMMON_METHODS:
                    out.append(f"{r}.{f.attr}" if r and r not in builtin else f.attr)
        return out

    def _dumped(self, stmts: list[ast.stmt]) -> str:
        return "".join([_dump(s, self.dumps) for s in stmts]) if self.hashed else ""

    def _signed(self, kind: str, name: str, of: list[str], text: str) -> str:
        return f"{kind}:{name}({','.join(of)})|body:{short_hash(text, 8)}" if self.hashed else ""

    def _decorators(self, node) -> list[str]:
        return [d for x in node.decorator_list if (d := _dotted(x.func if isinstance(x, ast.Call) else x))]

    def _refs(self, annotations: list[ast.AST | None]) -> list[str]:
        return list(dict.fromkeys(t for a in annotations for t in _type_names(a) if t not in vocab.PLAIN_TYPES))

    def _add(self, kind: str, name: str, node: ast.AST, sig: str, struct: str, **more) -> None:
        hashes = (short_hash(sig), short_hash(struct)) if self.hashed else ("", "")
        self.out.append(Entity(kind, name, node.lineno, node.end_lineno or node.lineno, *hashes, **more))

    def body(self, stmts: list[ast.stmt], scope: str = "", top: bool = True) -> None:
        for s in stmts:
            if isinstance(s, FUNCTIONS):
                self.function(s, scope)
            elif isinstance(s, ast.ClassDef):
                self.klass(s, scope)
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                self.imports(s)
            elif isinstance(s, ast.Assign) and top:
                self.variable(s)
            else:
                for block in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(s, block, None)
                    if isinstance(inner, list):
                        for x in inner:
                            if isinstance(x, ast.excepthandler):
                                self.body(x.body, scope, top)
                        self.body([x for x in inner if isinstance(x, ast.stmt)], scope, top)

    def function(self, n, scope: str) -> None:
        name = f"{scope}.{n.name}" if scope else n.name
        args = [a.arg for a in _args(n.args)]
        below = self.below[id(n)]
        types = self._context(n.body, n.args, below)
        text = self._dumped(n.body)
        self._add(
            "function", name, n, self._signed("func", n.name, args, text), f"{','.join(args)}|{','.join([type(s).__name__ for s in n.body])}",
            calls=self.calls(below.calls, scope, types), uses=below.loads, params=[a for a in args if a not in ("self", "cls")], decorators=self._decorators(n),
            type_refs=self._refs([n.returns, *(a.annotation for a in _args(n.args))]), type_context=types,
        )
        self.body(n.body, name, False)

    def klass(self, n: ast.ClassDef, scope: str) -> None:
        name = f"{scope}.{n.name}" if scope else n.name
        bases = [b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
        below, text = self.below[id(n)], self._dumped(n.body)
        notes = [s.annotation for s in n.body if isinstance(s, ast.AnnAssign)]
        self._add("class", name, n, self._signed("class", n.name, bases, text), ",".join(type(s).__name__ for s in n.body), calls=self.calls(below.calls, "", {}), uses=below.loads, inherits=bases, decorators=self._decorators(n), type_refs=self._refs(notes))
        self.body(n.body, name, False)

    def imports(self, n) -> None:
        for a in n.names:
            module = "" if isinstance(n, ast.Import) else n.module or ""
            self._add("import", a.asname or a.name, n, self._dumped([n]), type(n).__name__, imports=[{"module": module, "name": a.name}])

    def variable(self, n: ast.Assign) -> None:
        names = []
        for t in n.targets:
            if isinstance(t, ast.Name):
                names.append(t.id)
            elif isinstance(t, (ast.Tuple, ast.List)):
                names.append(", ".join(x.id for x in t.elts if isinstance(x, ast.Name)))
        below = _walk(n.value)
        for name in filter(None, names):
            listed = name == "__all__" and isinstance(n.value, (ast.List, ast.Tuple))
            uses = [x.value for x in n.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)] if listed else [x.id for x in below if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)]
            self._add("variable", name, n, self._dumped([n]), type(n).__name__, calls=self.calls([x for x in below if isinstance(x, ast.Call)], "", {}), uses=uses)

    def module_calls(self) -> None:
        """Calls outside of definitions, as an entity whose hash is the same for every version."""
        calls = [c for s in self.loose for c in self.calls(self.below[id(s)].calls, "", {})]
        if calls:
            last = max(s.end_lineno or s.lineno for s in self.loose)
            self.out.append(Entity("module_code", "__module__", 1, last, short_hash("module"), short_hash("module"), calls=calls))


def extract(source: str, hashed: bool = True) -> list[Entity]:
    """Entities of a module, none if it does not parse; ``hashed`` false leaves both hashes empty."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    m = _Module(tree, hashed)
    m.body(tree.body)
    m.module_calls()
    return m.out


def scopes(source: str) -> list[dict]:
    """Semantic paths: functions, classes, parameters and variables of every scope."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def add(chain, kind, name, sig, node):
        out.append({"scope_chain": list(chain), "entity_type": kind, "name": name, "signature_hash": short_hash(sig), "line_start": node.lineno, "line_end": node.end_lineno or node.lineno})

    def walk(stmts, chain):
        for s in stmts:
            if isinstance(s, FUNCTIONS):
                args = _args(s.args)
                add(chain, "function", s.name, f"{s.name}({','.join(a.arg for a in args)})|{len(s.args.defaults) + len([d for d in s.args.kw_defaults if d])}", s)
                for a in args:
                    add([*chain, s.name], "parameter", a.arg, f"{a.arg}:{ast.dump(a.annotation) if a.annotation else ''}", a)
                walk(s.body, [*chain, s.name])
            elif isinstance(s, ast.ClassDef):
                add(chain, "class", s.name, f"{s.name}({','.join(ast.dump(b) for b in s.bases)})", s)
                walk(s.body, [*chain, s.name])
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                for a in s.names:
                    add(chain, "import", a.asname or a.name, ast.dump(s), s)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for x in ast.walk(t):
                        if isinstance(x, ast.Name):
                            add(chain, "variable", x.id, ast.dump(s.value) if s.value else "", s)
            else:
                for block in ("body", "orelse", "finalbody"):
                    walk([x for x in getattr(s, block, []) if isinstance(x, ast.stmt)], chain)
                for h in getattr(s, "handlers", []):
                    walk(h.body, chain)

    walk(tree.body, [])
    return out
