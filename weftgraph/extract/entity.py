"""The entity row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa


def short_hash(text: str, n: int = 12) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:n]


@dataclass
class Entity:
    entity_type: str
    name: str
    line_start: int
    line_end: int
    signature_hash: str
    structure_hash: str
    calls: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    inherits: list[str] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)  #: {module, name}
    type_refs: list[str] = field(default_factory=list)
    params: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    type_context: dict[str, str] = field(default_factory=dict)

    def row(self) -> dict:
        return asdict(self)

    @staticmethod
    def columns() -> list[str]:
        return [f.name for f in fields(Entity)]


ENTITY_SCHEMA = (
    "entity_type string, name string, line_start int, line_end int, signature_hash string, structure_hash string, calls array<string>, uses array<string>, "
    "inherits array<string>, imports array<struct<module:string,name:string>>, type_refs array<string>, params array<string>, decorators array<string>, type_context map<string,string>"
)


_TEXT, _NUMBER, _LIST = pa.string(), pa.int32(), pa.list_(pa.string())
_TYPES = {"line_start": _NUMBER, "line_end": _NUMBER, "imports": pa.list_(pa.struct([("module", _TEXT), ("name", _TEXT)])), "type_context": pa.map_(_TEXT, _TEXT)}
_TYPES |= dict.fromkeys(("calls", "uses", "inherits", "type_refs", "params", "decorators"), _LIST)


def entity_batch(found: Iterable[tuple[str, list[Entity]]], columns: Sequence[str] | None = None, last: bool = False) -> pa.RecordBatch:
    """(file_path, ord, ...) of each file's entities, column by column.

    ``columns`` are those of the entity, all if not given; ``last`` keeps the last of a file's entities of
    each type and name, at its place.
    """
    paths, places, entities = [], [], []
    for path, of in found:
        at = list({(e.entity_type, e.name): k for k, e in enumerate(of)}.values()) if last else range(len(of))
        paths += [path] * len(at)
        places += at
        entities += [of[k] for k in at]
    made = {"file_path": pa.array(paths, _TEXT), "ord": pa.array(places, pa.int64())}
    for c in Entity.columns() if columns is None else columns:
        values = [getattr(e, c) for e in entities]
        made[c] = pa.array([list(v.items()) for v in values] if c == "type_context" else values, _TYPES.get(c, _TEXT))
    return pa.RecordBatch.from_pydict(made)
