"""A graph kept as versioned Parquet snapshots: each write makes a new directory and then moves the pointer."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver import schema
from sparkquiver.graph import Graph, complete, empty_graph
from sparkquiver.operators.search import index_nodes
from sparkquiver.schema import StorageError

TABLES = {"nodes": schema.NODE, "edges": schema.EDGE, "files": schema.FILE, "coverage": schema.COVERAGE, "embeddings": schema.EMBEDDING, "postings": schema.POSTING}


class GraphStore:
    """nodes and edges are written partitioned by kind, their commonest filter; the search index is kept with them."""

    def __init__(self, spark: SparkSession, path: str | Path, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, Path(path), read_only
        if read_only and self.version() is None:
            raise StorageError(f"no graph at {self.path}")

    def version(self) -> int | None:
        try:
            return int((self.path / "CURRENT").read_text())
        except (OSError, ValueError):
            return None

    def read(self) -> Graph:
        v = self.version()
        if v is None:
            return empty_graph(self.spark)
        at = self.path / f"v{v}"
        # A store of an earlier form has no vectors and no index.
        there = {n: ddl for n, ddl in TABLES.items() if n in ("nodes", "edges", "files", "coverage") or (at / n).exists()}
        return Graph(**{n: complete(self.spark.read.schema(ddl).parquet(str(at / n)), ddl) for n, ddl in there.items()})

    def write(self, graph: Graph) -> int:
        if self.read_only:
            raise StorageError("the store is open for reading")
        v = (self.version() or 0) + 1
        at = self.path / f"v{v}"
        for n, ddl in TABLES.items():
            df = getattr(graph, n)
            if n == "postings":  # sorted by term, so that a query reads the row groups of its terms
                df = (index_nodes(graph.nodes) if df is None else df).repartitionByRange("term").sortWithinPartitions("term")
            df = self.spark.createDataFrame([], ddl) if df is None else complete(df, ddl)
            w = df.write.mode("overwrite")
            (w.partitionBy("kind") if n in ("nodes", "edges") else w).parquet(str(at / n))
        new = self.path / "CURRENT.new"
        new.write_text(str(v))
        os.replace(new, self.path / "CURRENT")
        return v

    def clear(self) -> None:
        self.write(empty_graph(self.spark))

    def query_nodes(self, sql: str, **args: object) -> DataFrame:
        """Nodes by SQL over the view `nodes`, with named parameters."""
        self.read().nodes.createOrReplaceTempView("nodes")
        return self.spark.sql(sql, args=args or None)


def projects(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(path, nodes, edges, files) of each store in a folder."""
    parts = None
    for p in sorted(Path(folder).iterdir()):
        if (p / "CURRENT").exists():
            g = GraphStore(spark, p, read_only=True).read()
            one = g.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(g.edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True)).join(g.files.agg(F.count(F.lit(1)).alias("files")), F.lit(True)).select(F.lit(str(p)).alias("path"), "nodes", "edges", "files")
            parts = one if parts is None else parts.unionByName(one)
    return parts if parts is not None else spark.createDataFrame([], "path string, nodes bigint, edges bigint, files bigint")


def export_json(graph: Graph, limit: int | None = None) -> str:
    """The graph as JSON, at most limit nodes and twice as many edges where a limit is given; for small graphs, as it is built on
    the driver. write_json writes graphs of any size."""
    n, e = graph.nodes.orderBy("seq"), graph.edges.orderBy("seq")
    if limit is not None:
        n, e = n.limit(limit), e.limit(2 * limit)
    rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]
    return json.dumps({"nodes": rows(n), "edges": rows(e)}, indent=2, default=str)


def write_json(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")
