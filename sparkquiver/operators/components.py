"""Connected components over an edge DataFrame, without any driver-side state."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.schema import StorageError


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Where none is named, only a single process, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise StorageError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"quiver-ckpt-{os.getpid()}-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that later steps neither recompute it nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder as Parquet and read from there: as cut, but compressed, by column, and of a size that plans know."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip(os.sep)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that are few enough to be sent to every task, whatever they are joined with.
FEW = 10_000


def if_few(df: DataFrame) -> DataFrame:
    """df, broadcast if its rows, of which no more are looked at, are few: what it is joined with isn't shuffled then."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an undirected edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is one aggregation and one join, so a round costs a
    constant number of shuffles and the number of rounds is logarithmic in the longest path. Self loops, repeated edges
    and nulls are dropped; an empty edge table gives an empty result. Components that still change after max_rounds are an error.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(low.hint("merge"), "u")
        e = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise StorageError(f"components still change after {max_rounds} rounds")
    out = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().join(out.select(F.col("u").alias("node")), "node", "left_anti")
    return out.select(F.col("u").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component")))
