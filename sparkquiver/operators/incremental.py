"""Incremental indexing: what changed between two file snapshots, and a graph with those files replaced."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.graph import Graph
from sparkquiver.operators.resolve import last_wins, resolve_references
from sparkquiver.schema import InvalidRequest


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action) for two snapshots (path, mtime, content_hash): skip where the time is the same, refresh where only the time
    differs, changed, added or removed."""
    o = old.select("path", F.col("mtime").alias("om"), F.col("content_hash").alias("oh"))
    n = new.select("path", F.col("mtime").alias("nm"), F.col("content_hash").alias("nh"))
    action = (
        F.when(F.col("om").isNull() & F.col("oh").isNull(), "added")
        .when(F.col("nm").isNull() & F.col("nh").isNull(), "removed")
        .when(F.col("om").eqNullSafe(F.col("nm")), "skip")
        .when(F.col("oh").eqNullSafe(F.col("nh")), "refresh")
        .otherwise("changed")
    )
    return o.join(n, "path", "full_outer").select("path", action.alias("action"))


def replace_files(graph: Graph, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """graph without the nodes and edges of the given files (path) and with new ones put in; references are resolved anew.

    An edge goes with the file of its source, whether its source is the file or a node in it, so that a file indexed again
    doesn't double its edges; an edge into a node that went keeps its target as a name.
    """
    gone = graph.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept_nodes = graph.nodes.join(gone, "id", "left_anti")
    from_gone = gone.select(F.col("id").alias("source")).unionByName(paths.select(F.concat(F.lit("file:"), "path").alias("source"))).distinct()
    kept_edges = graph.edges.join(from_gone, "source", "left_anti")
    lost = graph.nodes.join(gone, "id", "left_semi").select(F.col("id").alias("target"), "name")
    named = kept_edges.join(lost, "target", "left").withColumn("target", F.when(F.col("name").isNotNull(), F.concat(F.lit("*:"), "name")).otherwise(F.col("target"))).select(*graph.edges.columns)
    all_nodes = last_wins(kept_nodes.unionByName(nodes), ["id"]).select(*graph.nodes.columns)
    all_edges = resolve_references(all_nodes, named.unionByName(edges))
    files = None if graph.files is None else graph.files.join(paths.select("path"), "path", "left_anti")
    return Graph(all_nodes, all_edges, files, graph.coverage)


def edge_sources_pointing_to(graph: Graph, ids: DataFrame) -> DataFrame:
    """(source): each node or name once from which an edge goes to one of ids (id)."""
    return graph.edges.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source").distinct()


def deleted(graph: Graph, what: str, value: str) -> Graph:
    """graph without a part of it: nodes_of_kind (their edges stay, as names), edges_of_kind, edges_from a source, what is incident to
    a node (the node and its edges), what is in a file, its record, or its coverage."""
    g, v = graph, F.lit(value)
    if what == "nodes_of_kind":
        return replace(g, nodes=g.nodes.where(~F.col("kind").eqNullSafe(v)))
    if what == "edges_of_kind":
        return replace(g, edges=g.edges.where(~F.col("kind").eqNullSafe(v)))
    if what == "edges_from":
        return replace(g, edges=g.edges.where(~F.col("source").eqNullSafe(v)))
    if what == "incident":
        return replace(g, nodes=g.nodes.where(~F.col("id").eqNullSafe(v)), edges=g.edges.where(~F.col("source").eqNullSafe(v) & ~F.col("target").eqNullSafe(v)))
    if what == "file":
        gone = g.nodes.where(F.col("file_path") == v).select("id")
        edges = g.edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
        return replace(g, nodes=g.nodes.where(~F.col("file_path").eqNullSafe(v)), edges=edges.select(*g.edges.columns))
    if what in ("file_record", "coverage"):
        table = "files" if what == "file_record" else "coverage"
        return replace(g, **{table: getattr(g, table).where(~F.col("path").eqNullSafe(v))})
    raise InvalidRequest(f"nothing is deleted by {what}")
