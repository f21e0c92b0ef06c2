"""A property graph as a handful of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquiver import schema


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    coverage: DataFrame | None = None
    #: Vectors (id, vec) of definitions, once they are related; the search index (term, id, tf, length), once it is built.
    embeddings: DataFrame | None = None
    postings: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


@lru_cache(maxsize=32)
def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def complete(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl, in order; those it lacks are null, flags false, positions 0."""
    want = struct_of(ddl)
    fill = {"boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0).cast("bigint")}
    out = []
    for f in want:
        kind = f.dataType.simpleString()
        c = F.col(f.name) if f.name in df.columns else fill.get(kind, F.lit(None))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*[spark.createDataFrame([], ddl) for ddl in (schema.NODE, schema.EDGE, schema.FILE, schema.COVERAGE)])


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A small graph of dictionaries, as tests and interactive work use it; seq is the place in the list."""
    n_cols, e_cols = schema.columns(schema.NODE), schema.columns(schema.EDGE)
    node = {"qualified_name": "", "file_path": "", "language": "rust", "start_line": 0, "end_line": 0, "start_column": 0, "end_column": 0, "is_exported": False, "is_async": False, "is_static": False, "is_abstract": False, "extra": {}}
    edge = {"line": 0, "col": 0}
    n = [tuple((node | x | {"seq": i}).get(c) for c in n_cols) for i, x in enumerate(nodes)]
    e = [tuple((edge | x | {"seq": i, "id": x.get("id", f"e{i}")}).get(c) for c in e_cols) for i, x in enumerate(edges)]
    g = Graph(spark.createDataFrame(n, schema.NODE), spark.createDataFrame(e, schema.EDGE))
    files = g.nodes.where("file_path <> ''").select(F.col("file_path").alias("path"), "language").distinct()
    return Graph(g.nodes, g.edges, complete(files, schema.FILE))
