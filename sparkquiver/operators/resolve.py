"""Resolution of edges whose target is only a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.operators.components import if_few, stored


def resolve_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with named targets replaced by nodes.

    A target that holds `:*` or starts with `*` names a node: its second last part between colons, or its last. Among nodes of that
    simple name one in the caller's file wins, then one under its directory, then any; the least seq decides. The source of a
    resolved edge that is a file becomes the first function, method or test of that file around the edge's line. Edges
    without a match stay as they are.
    """
    open_ = F.col("target").contains(":*") | F.col("target").startswith("*")
    todo, done = edges.where(open_), edges.where(~open_)
    parts = F.split("target", ":")
    wanted = F.when(F.col("target").startswith("*"), F.element_at(parts, -1)).otherwise(F.try_element_at(parts, F.lit(-2)))
    file_of = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    # Every later step reads these rows, some of them a few columns only; they are joined with their files once.
    key = stored(todo.withColumn("simple", wanted).join(file_of, "source", "left"))
    # Nodes of a name that no edge wants go first, without a shuffle while the names are small enough to be sent to the tasks.
    names = stored(key.select("simple").where("simple is not null").distinct())
    simple = F.element_at(F.split("name", "::"), -1)
    named = nodes.select(simple.alias("simple"), "file_path", F.struct("seq", "id").alias("at")).join(names, "simple", "left_semi")
    # The best node of a name in each file, under each directory and anywhere: aggregates first, so that a name that very many
    # nodes and edges share meets as one row a file, and never as their product.
    by_file = stored(named.groupBy("simple", "file_path").agg(F.min("at").alias("at")))
    parts_of = F.split("file_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts_of) - 1), lambda n: F.concat(F.array_join(F.slice(parts_of, 1, n), "/"), F.lit("/")))
    under = by_file.where(F.contains("file_path", F.lit("/"))).select("simple", F.explode(ancestors).alias("directory"), "at").groupBy("simple", "directory").agg(F.min("at").alias("near"))
    anywhere = by_file.groupBy("simple").agg(F.min("at").alias("any"))
    # A name is looked up once for each file that wants it; the edges themselves move once more, to what was found.
    pairs = key.select("simple", "source_file").where("simple is not null").distinct().withColumn("directory", F.regexp_replace("source_file", "[^/]*$", ""))
    pairs = pairs.join(by_file.select("simple", F.col("file_path").alias("source_file"), F.col("at").alias("here")), ["simple", "source_file"], "left").join(under, ["simple", "directory"], "left").join(anywhere, "simple", "left")
    pairs = pairs.select(F.col("simple").alias("_simple"), F.col("source_file").alias("_file"), F.coalesce("here.id", "near.id", "any.id").alias("found")).where("found is not null")
    found = lambda rows: rows.join(pairs, (F.col("simple") == F.col("_simple")) & F.col("source_file").eqNullSafe(F.col("_file")), "left").drop("_simple", "_file", "simple")
    by_files = F.coalesce(F.col("source").startswith("file:"), F.lit(False))
    # Only files that are sources need their functions.
    moving = key.where(by_files)
    inner = nodes.where(F.col("kind").isin("function", "method", "test")).select(F.col("file_path").alias("source_file"), F.col("id").alias("inner"), "start_line", "end_line", F.col("seq").alias("inner_seq"))
    inner = inner.join(if_few(moving.select("source_file").where("source_file is not null").distinct()), "source_file", "left_semi")
    moved = moving.select("id", "seq", "source_file", "line").join(inner, "source_file").where("line between start_line and end_line")
    moved = moved.groupBy("id", "seq").agg(F.min(F.struct("inner_seq", "inner")).alias("m")).select("id", "seq", F.col("m.inner").alias("inner"))
    moving = found(moving).join(moved, ["id", "seq"], "left").withColumn("source", F.when(F.col("found").isNotNull(), F.coalesce("inner", "source")).otherwise(F.col("source")))
    out = found(key.where(~by_files)).select(*edges.columns, "found").unionByName(moving.select(*edges.columns, "found"))
    return done.unionByName(out.withColumn("target", F.coalesce("found", "target")).select(*edges.columns))


def last_wins(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """One row a key, that with the greatest order, and version: how many rows there were."""
    w = Window.partitionBy(*key)
    return rows.withColumn("version", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """old with the rows of new put in or replaced; a replaced row's version goes up by the rows that replace it.

    old has a column version, new has none; of rows of new that share a key the last by order stays.
    """
    fresh = last_wins(new, key, order).withColumnRenamed("version", "_added")
    before = old.select(*key, F.col("version").alias("_before"))
    fresh = fresh.join(before, key, "left").withColumn("version", (F.coalesce("_before", F.lit(0)) + F.col("_added")).cast("long")).drop("_before", "_added")
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
