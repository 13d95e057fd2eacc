"""Source files to entity rows: one extractor for each language, behind one registry and one table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial as partial_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import on_workers
from . import partial, patterns, python_ast
from .entity import ENTITY_SCHEMA, Entity, entity_batch

#: Files whose entities a worker holds before it sends them on.
FILES_AT_ONCE = 2000
#: language -> (extensions, function from source text to entities); open to users through ``register``.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[[str], list[Entity]]]] = {}


#: Extractors that have a cheaper form without hashes.
UNHASHED = {python_ast.extract: partial_(python_ast.extract, hashed=False)}


def register(language: str, extensions: tuple[str, ...], extractor: Callable[[str], list[Entity]]) -> None:
    REGISTRY[language] = (extensions, extractor)


register("python", (".py", ".pyi"), python_ast.extract)
for _name, _spec in patterns.LANGUAGES.items():
    register(_name, _spec.extensions, patterns.Extractor(_spec))


def language_of(path: str) -> str | None:
    """The first registered language with the path's extension."""
    for name, (extensions, _) in REGISTRY.items():
        if path.endswith(extensions):
            return name
    return None


def extract_one(path: str, content: str, hashed: bool = True) -> list[Entity]:
    """A file's entities; extractors do not raise, and unknown files have none."""
    language = language_of(path)
    if language is None:
        return []
    extractor = REGISTRY[language][1]
    try:
        return extractor(content) if hashed else UNHASHED.get(extractor, extractor)(content)
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract_entities(files: DataFrame) -> DataFrame:
    """A row for each entity of ``files`` (file_path, content), with ``ord``, its place in the file.

    Files are parsed where they lie, batch by batch; nothing is shuffled.
    """
    on_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES_AT_ONCE):
                part = b.slice(at, FILES_AT_ONCE)
                found = [(path, extract_one(path, content or "")) for path, content in zip(part["file_path"].to_pylist(), part["content"].to_pylist(), strict=True)]
                yield entity_batch(found)

    return files.select("file_path", "content").mapInArrow(run, f"file_path string, ord bigint, {ENTITY_SCHEMA}")


#: What a node of the graph keeps of its entity.
NODE_SCHEMA = "entity_type string, name string, line_start int, calls array<string>, inherits array<string>, imports array<struct<module:string,name:string>>, type_refs array<string>, decorators array<string>, uses array<string>"


def extract_nodes(files: DataFrame) -> DataFrame:
    """As ``extract_entities``, the last entity of each type and name of a file, without what nodes do not keep.

    ``files`` (file_path, content) has a row a file. Hashes are not worked out.
    """
    on_workers(files.sparkSession)
    columns = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES_AT_ONCE):
                part = b.slice(at, FILES_AT_ONCE)
                found = [(path, extract_one(path, content or "", False)) for path, content in zip(part["file_path"].to_pylist(), part["content"].to_pylist(), strict=True)]
                yield entity_batch(found, columns, last=True)

    return files.select("file_path", "content").mapInArrow(run, f"file_path string, ord bigint, {NODE_SCHEMA}")


def parse_regions(files: DataFrame) -> DataFrame:
    """(file_path, line_start, line_end, status, confidence, names) of broken sources."""
    on_workers(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = [{"file_path": p, **r} for p, c in zip(b["file_path"], b["content"], strict=True) for r in partial.regions(c or "")]
            yield pd.DataFrame(rows, columns=["file_path", "line_start", "line_end", "status", "confidence", "names"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, line_start int, line_end int, status string, confidence double, names array<string>")


def semantic_paths(files: DataFrame) -> DataFrame:
    """(file_path, scope_chain, entity_type, name, signature_hash, line_start, line_end, fqn, unique_id, scope_depth)."""
    on_workers(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = [{"file_path": p, **r} for p, c in zip(b["file_path"], b["content"], strict=True) for r in python_ast.scopes(c or "")]
            yield pd.DataFrame(rows, columns=["file_path", "scope_chain", "entity_type", "name", "signature_hash", "line_start", "line_end"])

    t = files.select("file_path", "content").mapInPandas(run, "file_path string, scope_chain array<string>, entity_type string, name string, signature_hash string, line_start int, line_end int")
    fqn = F.concat_ws("::", F.array("file_path"), F.col("scope_chain"), F.array("name"))
    return t.withColumn("fqn", fqn).withColumn("unique_id", F.left(F.sha2(F.concat_ws("|", fqn, "entity_type"), 256), F.lit(16))).withColumn("scope_depth", F.size("scope_chain"))
