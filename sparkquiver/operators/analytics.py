"""Statistics, dead code, complexity and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.functions.paths import entry_point
from sparkquiver.graph import Graph
from sparkquiver.schema import NotFound, StorageError


def node_kinds(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind")


def edge_kinds(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind")


def stats(graph: Graph) -> DataFrame:
    """One row: total_nodes, total_edges, total_files."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("total_nodes"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("total_edges"))
    f = graph.files.agg(F.count(F.lit(1)).alias("total_files"))
    return n.join(e, F.lit(True)).join(f, F.lit(True))


def is_entry(c: str = "") -> Column:
    at = lambda x: F.col(f"{c}{x}")
    return entry_point(at("name"), at("file_path"), at("is_exported"), at("visibility"))


def dead_code(graph: Graph) -> DataFrame:
    """Functions, methods and tests that no call reaches and that start nothing, by file and name."""
    # A called node counts once, however many calls reach it; nodes stream past a hash of the called ones, so neither side is sorted.
    called = graph.edges.where("kind = 'calls'").select(F.col("target").alias("id")).distinct()
    dead = graph.nodes.where(F.col("kind").isin("function", "method", "test") & ~is_entry()).join(called.hint("shuffle_hash"), "id", "left_anti")
    return dead.select("id", "kind", "name", "qualified_name", "file_path", "start_line").orderBy("file_path", "name", "id")


def dead_code_report(graph: Graph) -> DataFrame:
    """One row: total_functions, entry_points (of all kinds), dead."""
    counts = graph.nodes.agg(F.count_if(F.col("kind").isin("function", "method", "test")).alias("total_functions"), F.count_if(is_entry()).alias("entry_points"))
    return counts.join(dead_code(graph).agg(F.count(F.lit(1)).alias("dead")), F.lit(True))


METRICS = ("cyclomatic", "cognitive", "loop_depth", "alloc_in_loop", "linear_scan_in_loop", "recursion", "unguarded_recursion")


def complexity(graph: Graph, node_id: str) -> DataFrame:
    """The metrics that a node carries; no row where one is missing or unreadable."""
    found = graph.nodes.where(F.col("id") == node_id)
    if found.isEmpty():
        raise NotFound(node_id)
    return complexity_of(found)


def complexity_of(nodes: DataFrame) -> DataFrame:
    kind = {"cyclomatic": "int", "cognitive": "int", "loop_depth": "int"}
    cols = [F.try_element_at("extra", F.lit(m)).try_cast(kind.get(m, "boolean")).alias(m) for m in METRICS]
    return nodes.select("id", *cols).dropna(subset=list(METRICS))


def coverage_counts(graph: Graph, prefix: str | None = None) -> DataFrame:
    """One row: indexed, skipped, parse_error, under a prefix whose % and _ are wildcards, regardless of ASCII case."""
    return _covered(graph, prefix).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "parse_error")])


def coverage_entries(graph: Graph, prefix: str | None = None) -> DataFrame:
    """What isn't indexed, by path."""
    return _covered(graph, prefix).where("status <> 'indexed'").select("path", "language", "status", "reason", "size_bytes").orderBy("path")


def _covered(graph: Graph, prefix: str | None) -> DataFrame:
    if graph.coverage is None:
        raise StorageError("this graph has no coverage table; build it anew")
    return graph.coverage if not prefix else graph.coverage.where(F.col("path").ilike(prefix + "%"))
