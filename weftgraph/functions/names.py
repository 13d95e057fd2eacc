"""Names, paths and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Test-file suffixes and folders, framework prefixes, roots of propagation priorities.
TEST_SUFFIXES = ("_test.py", "_test.go", "_test.rs", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "Test.java", "Tests.java", "_test.cpp", "_test.cc", "_test.c")
TEST_FOLDERS = ("tests", "test", "testing", "__tests__", "spec")
FRAMEWORK_PREFIXES = ("test_", "visit_", "setUp", "tearDown")
ENTRY_NAMES = ("main", "__main__", "__module__")
PASSIVE_TYPES = ("import", "module_code", "variable")


def node_id(file_path: Column, kind: Column, name: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", file_path, kind, name), 256), F.lit(16))


def bare(name: Column) -> Column:
    """The part after the last dot."""
    return F.substring_index(name, ".", -1)


def qualifier(name: Column) -> Column:
    """All before the last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_dunder(name: Column) -> Column:
    return F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))


def is_test_file(path: Column) -> Column:
    """A ``test_`` file, one with a test suffix, or one in a test folder."""
    name = base_name(path)
    suffix = F.lit(False)
    for s in TEST_SUFFIXES:
        suffix = suffix | F.endswith(name, F.lit(s))
    return F.startswith(name, F.lit("test_")) | suffix | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def mentions_test(path: Column) -> Column:
    """The looser test of propagation and zones: ``test`` anywhere in the path."""
    return F.lower(path).contains("test")


def shared_components(a: Column, b: Column) -> Column:
    """How many leading components two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def diagram_id(name: Column) -> Column:
    return F.translate(name, "./- ", "____")
