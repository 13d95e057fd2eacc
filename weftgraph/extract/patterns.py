"""Six languages by patterns over text whose comments and strings are blanked.

A language is a table of declaration and import patterns. Declarations have a body, the next balanced
block; those inside a class are named after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from re import _constants, _parser

from ..functions import vocab
from .entity import Entity, short_hash

# Words that look like calls or declarations and are neither.
KEYWORDS = frozenset("if for while switch catch return else do try new delete throw sizeof typeof await yield match loop fn func function super this constructor case default in of instanceof using namespace template operator static const let var".split())


@dataclass(frozen=True)
class Declaration:
    kind: str
    pattern: str  #: groups: name, and perhaps params and bases
    container: bool = False
    guarded: bool = False  #: keywords are no names here


@dataclass(frozen=True)
class Import:
    pattern: str
    names: str = "name"  #: how group ``names`` is read: name, list, star, path
    module: str | None = None  #: a fixed module, if the pattern has no group for it


@dataclass(frozen=True)
class Language:
    extensions: tuple[str, ...]
    declarations: tuple[Declaration, ...]
    imports: tuple[Import, ...]
    decorator: str | None = None
    type_refs: str | None = None
    jsx: bool = False
    quotes: str = "\"'`"
    bases_split: str = r","
    plain_decorators: frozenset[str] = field(default_factory=frozenset)


_ID = r"[A-Za-z_$][\w$]*"
_EXPORT = r"^[ \t]*(?:export\s+)?(?:default\s+)?"
_TS_FUNCTIONS = (
    Declaration("function", _EXPORT + rf"(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)"),
    Declaration("function", _EXPORT + rf"(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\((?P<params>[^)]*)\)|{_ID})\s*(?::[^=\n]+)?=>"),
    Declaration("function", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?P<name>{_ID})\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)\s*(?::[^{{;\n]+)?\{{", guarded=True),
)
_TS_CLASS = Declaration("class", _EXPORT + rf"(?:abstract\s+)?class\s+(?P<name>{_ID})(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[^{{]+?))?(?:\s+implements\s+[^{{]+)?\s*\{{", container=True)
_TS_IMPORTS = (
    Import(r"import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{(?P<names>[^}]*)\}\s*from\s*['\"](?P<module>[^'\"]+)['\"]", "list"),
    Import(rf"import\s+(?:type\s+)?(?P<names>{_ID})\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*['\"](?P<module>[^'\"]+)['\"]"),
    Import(rf"import\s*\*\s*as\s+(?P<names>{_ID})\s*from\s*['\"](?P<module>[^'\"]+)['\"]"),
    Import(rf"(?:const|let|var)\s+(?P<names>{_ID})\s*=\s*require\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)"),
)
_JS_EXT, _TS_EXT = (".js", ".jsx", ".mjs", ".cjs"), (".ts", ".tsx")
_C_FUNCTION = r"^[ \t]*(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?P<name>(?:\w+::)*~?[a-z_]\w*)\s*\((?P<params>[^;{)]*)\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?"
_INCLUDES = (Import(r'^[ \t]*#\s*include\s*"(?P<names>[^"]+)"', "path", "."), Import(r"^[ \t]*#\s*include\s*<(?P<names>[^>]+)>", "path", ""))

LANGUAGES: dict[str, Language] = {
    "typescript": Language(
        _TS_EXT,
        (*_TS_FUNCTIONS, _TS_CLASS, Declaration("class", _EXPORT + rf"interface\s+(?P<name>{_ID})(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[^{{]+?))?\s*\{{", container=True), Declaration("class", _EXPORT + rf"(?:const\s+)?enum\s+(?P<name>{_ID})\s*\{{", container=True), Declaration("variable", _EXPORT + rf"type\s+(?P<name>{_ID})(?:<[^>]*>)?\s*=")),
        _TS_IMPORTS, decorator=r"^\s*@([\w.]+)", type_refs=r"[:<]\s*([A-Z]\w*)", jsx=True,
    ),
    "javascript": Language(_JS_EXT, (*_TS_FUNCTIONS, _TS_CLASS), _TS_IMPORTS, decorator=r"^\s*@([\w.]+)"),
    "rust": Language(
        (".rs",),
        (
            Declaration("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)"),
            Declaration("function", r"^[ \t]*macro_rules!\s*(?P<name>\w+)"),
            Declaration("class", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(?P<name>\w+)", container=True),
            Declaration("class", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<bases>[^{]+?))?\s*\{", container=True),
            Declaration("class", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)", container=True),
            Declaration("variable", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
            Declaration("variable", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:"),
            Declaration("module_code", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"),
        ),
        (
            Import(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)::\{(?P<names>[^}]*)\}\s*;", "list"),
            Import(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)::(?P<names>\*)\s*;", "star"),
            Import(r"^[ \t]*(?:pub\s+)?use\s+(?:(?P<module>[\w:]+)::)?(?P<names>\w+)\s+as\s+\w+\s*;"),
            Import(r"^[ \t]*(?:pub\s+)?use\s+(?:(?P<module>[\w:]+)::)?(?P<names>\w+)\s*;"),
        ),
        decorator=r"^\s*#\[\s*([\w:]+)", quotes='"', bases_split=r"\+",
    ),
    "cpp": Language(
        (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"),
        (
            Declaration("function", _C_FUNCTION + r"(?:\{|;)", guarded=True),
            Declaration("function", r"^[ \t]*(?:explicit\s+)?(?P<name>[A-Z]\w*(?:::~?\w+)?)\s*\((?P<params>[^;{)]*)\)\s*(?::[^{;]*)?\{", guarded=True),
            Declaration("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[^{;]+?))?\s*\{", container=True),
            Declaration("class", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)[^;{]*\{", container=True),
            Declaration("class", r"^[ \t]*namespace\s+(?P<name>\w+)\s*\{", container=True),
            Declaration("variable", r"^[ \t]*using\s+(?P<name>\w+)\s*="),
            Declaration("variable", r"^[ \t]*typedef\s+[^;]*?(?P<name>\w+)\s*;"),
        ),
        (*_INCLUDES, Import(r"^[ \t]*using\s+namespace\s+(?P<names>[\w:]+)\s*;", "path", "")),
        quotes='"\'',
    ),
    "c": Language(
        (".c",),
        (
            Declaration("function", _C_FUNCTION + r"\{", guarded=True),
            Declaration("class", r"^[ \t]*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{", container=True),
            Declaration("variable", r"^[ \t]*typedef\s+[^;{]*?(?P<name>\w+)\s*;"),
            Declaration("variable", r"^[ \t]*#\s*define\s+(?P<name>\w+)"),
        ),
        _INCLUDES, quotes='"\'',
    ),
    "java": Language(
        (".java",),
        (
            Declaration("function", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?[\w<>\[\],.?\s]+?\s+(?P<name>[a-z_]\w*)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w,.\s]+)?\s*[{;]", guarded=True),
            Declaration("function", r"^[ \t]+(?:(?:public|private|protected)\s+)?(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w,.\s]+)?\s*\{", guarded=True),
            Declaration("class", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*class\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[\w.<>]+))?(?:\s+implements\s+[^{]+)?\s*\{", container=True),
            Declaration("class", r"^[ \t]*(?:(?:public|private|protected|static)\s+)*interface\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[^{]+?))?\s*\{", container=True),
            Declaration("class", r"^[ \t]*(?:(?:public|private|protected|static|final)\s+)*(?:enum|record)\s+(?P<name>\w+)\s*(?:\([^)]*\))?(?:\s+implements\s+(?P<bases>[^{]+?))?\s*\{", container=True),
            Declaration("class", r"^[ \t]*(?:public\s+)?@interface\s+(?P<name>\w+)\s*\{", container=True),
        ),
        (Import(r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.]+)\.(?P<names>\w+|\*)\s*;", "star"),),
        decorator=r"^\s*@(\w+)", type_refs=r"[<,]\s*([A-Z]\w*)", quotes='"\'',
        plain_decorators=frozenset("Override Deprecated SuppressWarnings FunctionalInterface SafeVarargs".split()),
    ),
}


@lru_cache(maxsize=64)
def _hidden(quotes: str) -> re.Pattern:
    parts = [r"//[^\n]*", r"/\*.*?\*/", *(rf"{q}(?:\\.|[^{q}\\])*{q}" for q in map(re.escape, quotes))]
    return re.compile("|".join(parts), re.S)


_NOT_LINE = re.compile(r"[^\n]")


def blanked(source: str, quotes: str) -> str:
    """The source with comments and strings as spaces, newlines kept: offsets stay."""
    return _hidden(quotes).sub(lambda m: _NOT_LINE.sub(" ", m[0]) if "\n" in m[0] else " " * len(m[0]), source)


_BRACE = re.compile(r"[{}]")


class _Braces:
    """The balanced blocks of a text, found in one pass."""

    def __init__(self, text: str):
        self.at = [m.start() for m in _BRACE.finditer(text)]
        self.ends, opened = [len(text)] * len(self.at), []
        for k, i in enumerate(self.at):
            if text[i] == "{":
                opened.append(k)
            else:
                self.ends[k] = i + 1
                if opened:
                    self.ends[opened.pop()] = i + 1

    def end(self, at: int, last: int) -> int:
        """Where the first block from ``at`` on ends, or a brace that closes another; ``last`` without one."""
        k = bisect_left(self.at, at)
        return self.ends[k] if k < len(self.at) else last


class _Lines:
    """The line of an offset."""

    def __init__(self, source: str):
        self.breaks = [m.start() for m in _BREAK.finditer(source)]

    def __call__(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1


_BREAK = re.compile(r"\n")
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*!?\(")


def calls_in(text: str) -> list[str]:
    """Called names in order, once each; keywords, built-ins and common methods are left out."""
    out: dict[str, None] = {}
    builtin = vocab.builtin_names()
    for m in _CALL.finditer(text):
        name = m[1].replace("::", ".").replace("->", ".")
        head, last = name.split(".", 1)[0], name.rsplit(".", 1)[-1]
        if last in KEYWORDS or name == last and last in builtin or name != last and last in vocab.COMMON_METHODS:
            continue
        out[last if head in ("this", "self", "super") else name] = None
    return list(out)


_GUARD = re.compile(r"\s*(?:return|else|new|throw|delete|await)\b")
_ALIAS, _TYPE = re.compile(r"\s+as\s+"), re.compile(r"^type\s+")
_AFTER_NAME, _AFTER_TYPED, _SPACES = re.compile(r"[:=]"), re.compile(r"[:?=]"), re.compile(r"[\s*&]+")
_ACCESS, _GENERIC = re.compile(r"\b(?:public|private|protected|virtual)\b"), re.compile(r"<.*")
_JSX = re.compile(r"<([A-Z]\w*)[\s/>]")


def _word(pattern: re.Pattern) -> str:
    """The longest text that every match holds; a source without it need not be searched."""
    run = best = ""
    for op, arg in _parser.parse(pattern.pattern, pattern.flags):
        run = run + chr(arg) if op is _constants.LITERAL else ""
        best = max(best, run, key=len)
    return best


class Extractor:
    def __init__(self, spec: Language):
        self.spec = spec
        self.declarations = [(d, p := re.compile(d.pattern, re.M), _word(p)) for d in spec.declarations]
        self.imports = [(i, p := re.compile(i.pattern, re.M), _word(p)) for i in spec.imports]
        self.bases, self.decorator, self.type_refs = (re.compile(p) if p else None for p in (spec.bases_split, spec.decorator, spec.type_refs))

    def __call__(self, source: str) -> list[Entity]:
        text = blanked(source, self.spec.quotes)
        lines = _Lines(source)
        return [*self._imported(source, lines), *self._declared(source, text, lines)]

    def _imported(self, source: str, lines: _Lines) -> list[Entity]:
        """Imports, matched on the source itself, as their modules are strings."""
        out = []
        for spec, pattern, word in self.imports:
            if word not in source:
                continue
            for m in pattern.finditer(source):
                module = spec.module if spec.module is not None else (m.groupdict().get("module") or "")
                line, last = lines(m.start()), lines(m.end())
                names = [m["names"].strip()] if spec.names != "list" else [_TYPE.sub("", x.strip()) for x in m["names"].split(",") if x.strip()]
                h = short_hash(m[0])
                for n in names:
                    name, *_, known = [*(p := _ALIAS.split(n)), p[-1]]
                    out.append(Entity("import", known, line, last, h, h, imports=[{"module": module, "name": name}]))
        return out

    def _declared(self, source: str, text: str, lines: _Lines) -> list[Entity]:
        found, braces = [], _Braces(text)
        for d, pattern, word in self.declarations:
            if word not in text:
                continue
            for m in pattern.finditer(text):
                name = m["name"]
                if not name or d.guarded and name.split("::")[-1] in KEYWORDS or d.guarded and _GUARD.match(m[0]):
                    continue
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                semi = text.find(";", m.end() - 1)
                brace = text.find("{", m.end() - 1)
                short = d.kind == "variable" or semi >= 0 and (brace < 0 or semi < brace) or m[0].endswith(";")
                end = (semi + 1 if semi >= 0 else m.end()) if short else braces.end(m.end() - 1, len(text))
                if "#" in m[0][:20] and "define" in m[0]:
                    end = text.find("\n", m.end()) if text.find("\n", m.end()) >= 0 else len(text)
                found.append((start, end, d, m))
        found.sort(key=lambda f: (f[0], -f[1]))
        out, stack, seen = [], [], set()
        for start, end, d, m in found:
            while stack and stack[-1][0] <= start:
                stack.pop()
            name = m["name"].replace("::", ".")
            full = f"{stack[-1][1]}.{name}" if stack else name
            if (start, full) in seen:
                continue
            seen.add((start, full))
            if d.container:
                stack.append((end, full))
            out.append(self._entity(source, text, lines, start, end, full, name, d, m))
        return out

    def _entity(self, source, text, lines, start, end, full, name, d, m) -> Entity:
        span, groups = source[start:end], m.groupdict()
        line, last = lines(start), lines(max(start, end - 1))
        params = [_SPACES.split(_AFTER_NAME.split(p)[0].strip())[-1] if ":" not in p else _AFTER_TYPED.split(p)[0].strip() for p in (groups.get("params") or "").split(",") if p.strip()]
        bases = []
        for b in self.bases.split(groups.get("bases") or ""):
            b = _GENERIC.sub("", _ACCESS.sub("", b)).strip().split("::")[-1].split(".")[-1]
            if b[:1].isupper():
                bases.append(b)
        body = text[m.end() : end] if d.kind in ("function", "class") else ""
        calls = calls_in(body)
        if self.spec.jsx:
            calls = list(dict.fromkeys([*calls, *_JSX.findall(span)]))
        refs = list(dict.fromkeys(t for t in self.type_refs.findall(text[start:end]) if t not in vocab.PLAIN_TYPES)) if self.type_refs else []
        return Entity(d.kind, full, line, last, short_hash(span), short_hash(span.replace(name.split(".")[-1], "___", 1)), calls=calls, inherits=bases, type_refs=refs, params=[p for p in params if p not in ("self", "this", "void", "")], decorators=self._decorators(source, start))

    def _decorators(self, source: str, start: int) -> list[str]:
        """The lines right above that are decorators, nearest last."""
        if not self.decorator:
            return []
        out, end = [], source.rfind("\n", 0, start)  # of the line above
        while end >= 0:
            begin = source.rfind("\n", 0, end) + 1
            x, end = source[begin:end], begin - 1
            m = self.decorator.match(x)
            if not m:
                if x.strip() or self.spec.extensions != (".rs",):
                    break
                continue
            if m[1] not in self.spec.plain_decorators:
                out.append(m[1])
        return out[::-1]
