"""Paths of files and of HTTP routes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquiver.functions.text import let

LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp"}


def language_of(path: Column) -> Column:
    """Language by extension, case as it is; null where there's none."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def package_of(path: Column, depth: int = 2) -> Column:
    """The first depth directories of a path, without its file name; '' for a file at the root."""
    return let(F.split(path, "/"), lambda p: F.array_join(F.slice(p, F.lit(1), F.least(F.lit(depth), F.size(p) - 1)), "/"))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(normalize_http_path(path), "/"), lambda s: s != "")


def normalize_http_path(path: Column) -> Column:
    """One slash between segments, none at the end; a whole segment that is a parameter or wildcard becomes *."""
    one = F.regexp_replace(path, "/{2,}", "/")
    parts = F.transform(F.split(one, "/"), lambda s: F.when(s.rlike(r"^(:.+|\{.*\}|<.*>|\*.*)$"), F.lit("*")).otherwise(s))
    joined = F.regexp_replace(F.array_join(parts, "/"), "/+$", "")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)tests/|_test\.rs$|\.test\.ts$|\.spec\.ts$|_spec\.rb$")


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Any of the extensions, which may have several parts, regardless of case."""
    low, hit = F.lower(path), F.lit(False)
    for e in extensions:
        hit = hit | low.endswith("." + e.lower().lstrip("."))
    return hit


def entry_point(name: Column, path: Column, exported: Column, visibility: Column) -> Column:
    """The storage form: names and directories that start programs, and public names."""
    by_path = path.ilike("%/bin/%") | path.ilike("%/main.%") | path.ilike("%/index.%")
    return name.isin("main", "index", "__init__") | by_path | exported | F.coalesce(visibility.isin("public", "pub"), F.lit(False))


def entry_point_loose(name: Column, path: Column, exported: Column, visibility: Column) -> Column:
    """The layering form: main. and index. count wherever they stand in a path, in this case only."""
    by_path = path.contains("/bin/") | path.contains("main.") | path.contains("index.")
    return name.isin("main", "index", "__init__") | by_path | exported | F.coalesce(visibility.isin("public", "pub"), F.lit(False))
