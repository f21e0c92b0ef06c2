"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space that separates words in every contract here.
SPACE = "\t\n\x0b\x0c\r "
WORD = "[^\x20\x09-\x0d]+"
#: Characters of text that a batch handles at a time, so that a run of very long texts stays bounded.
CHUNK = 8_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def release(spark) -> None:
    """Have the driver collect what it no longer refers to, so that Spark deletes the shuffle and checkpoint files of finished steps.

    Files go only with their last reference; without this, those of all steps of a long operator lie on disk until the driver's
    memory happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a single small file would else be one task's work. An input of
    more splits than that, as any large one is, stays as it was scanned."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(columns, schema)], schema=schema)


def map_rows(df: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Run a Python operator over Arrow batches: make() runs once a task and gives a function from column lists to rows; an
    attribute close of it, if there, gives the rows that come last.

    Only the named columns reach Python, so extra columns, whatever their names, cost nothing and clash with nothing.
    """
    schema = arrow_schema(ddl)

    def run(batches):
        f = make()
        for batch in batches:
            n, at = batch.num_rows, 0
            text = next((batch.column(i) for i, x in enumerate(batch.schema) if pa.types.is_string(x.type)), None)
            while at < n:
                step = n - at
                while step > 1 and text is not None and text.slice(at, step).nbytes > CHUNK:
                    step //= 2
                rows = list(f(*(batch.column(i).slice(at, step).to_pylist() for i in range(batch.num_columns))))
                at += step
                yield _batch(rows, schema)
        if hasattr(f, "close"):
            yield _batch(list(f.close()), schema)

    return df.select(*columns).mapInArrow(run, ddl)


def replace_texts(df: DataFrame, text_col: str, length_col: str, new_text: Callable[..., str | None], drop: str | None = None) -> DataFrame:
    """df with text_col as new_text makes it, and length_col, if there, set to the length of each text that changed.

    Other columns pass as Arrow arrays, untouched. drop names a column that new_text gets too and that isn't returned.
    """
    names = df.columns
    text_at, length_at, drop_at = (names.index(c) if c in names else None for c in (text_col, length_col, drop))
    out = T.StructType([x for x in df.schema.fields if x.name != drop])

    def run(batches):
        for batch in batches:
            n, at = batch.num_rows, 0
            while at < n:
                step = n - at
                while step > 1 and batch.column(text_at).slice(at, step).nbytes > CHUNK:
                    step //= 2
                part = batch.slice(at, step)
                at += step
                old = part.column(text_at).to_pylist()
                new = [new_text(*x) for x in zip(old, *([part.column(drop_at).to_pylist()] if drop_at is not None else []))]
                columns = list(part.columns)
                columns[text_at] = pa.array(new, type=columns[text_at].type)
                if length_at is not None:
                    size = columns[length_at]
                    columns[length_at] = pa.array([k if a == b or b is None else len(b) for a, b, k in zip(old, new, size.to_pylist())], type=size.type)
                keep = [i for i in range(len(columns)) if i != drop_at]
                yield pa.RecordBatch.from_arrays([columns[i] for i in keep], names=out.names)

    # By place, as names that hold a dot or a backtick can't be asked for.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, out)
