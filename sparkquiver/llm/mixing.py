"""Mixing sources to target weights.

Each source's words, in a pseudorandom order of its documents, are cut into blocks of fixed length. The mix is a row of output
shards of equal size; a shard gets each source's whole expected blocks and draws the rest from a multinomial. A source's
slots, numbered through the shards, go through a pseudorandom permutation of its block indexes, another one each epoch, and
blocks join slots by index. No source gives more than two epochs, so no document gives more than twice its words.

Sources take one row each in the table that targets are made from, and that table alone is sorted in one task. A source's
documents are dealt to buckets of about BUCKET rows for their running offsets, so a hot source is many tasks' work.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquiver.llm.common import WORD, columns_of, free_name, replace_texts
from sparkquiver.operators.components import cut

BLOCK, SHARD, BUCKET = 256, 1024, 20_000
#: Shards whose slots one window numbers.
RUN = 4096
WEIGHTS = (5, 2, 1)


def permute(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) at k: a four-round Feistel network, walked until it falls within n."""
    half = (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, top, seed = k.astype(np.uint64), n.astype(np.uint64), seed.astype(np.int64).view(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right, h, m, s = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], seed[todo]
        for r in range(4):
            z = (right + s + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z >> np.uint64(32)) & m)
        x[todo] = (left << h) | right
        todo = x >= top
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(k: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permute(k.to_numpy(), n.to_numpy(), seed.to_numpy()))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, mark, copy): mark and copy tell rows with one id apart; equal rows differ in copy only."""
    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = one.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    return one.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "mark").orderBy("size")))


def source_targets(rows: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, s, source_size, n_rows, target): shares of `share` times all words by weight, none above twice its source."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by = by.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"))
    cap = 2.0 * F.col("source_size")
    order = Window.orderBy(cap / F.col("w"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(everything) * share)
    # The level at which sources from this one on share what those before it, capped, leave; the first level that caps no more holds.
    left = F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    over = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("place", F.row_number().over(order)).withColumn("level", left / over)
    level = F.min(F.when(cap / F.col("w") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    return by.withColumn("target", F.least(cap, F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).select("source", "s", "source_size", "n_rows", "target")


def draw(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: (doc_id, mark, copy, size, source_size, target), one for each row of df. pieces: what the mix holds,
    (doc_id, source, mark, copy, shard, slot, epoch, block, start, words): words of a document from word start on.

    Null text counts as empty; null sources come last and are one source; repeated rows count each. Reruns agree.
    """
    rows = cut(sized(df, id_col, text_col, source_col))
    targets = cut(source_targets(rows, share, weights))
    rows = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.s", "t.source_size", "t.n_rows", "t.target")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.ceil(F.col("n_rows") / BUCKET)))
    run = Window.partitionBy("s", "bucket").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed + 1)), "doc_id", "mark", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut(rows.withColumn("offset", F.coalesce(F.sum("size").over(run), F.lit(0))).drop("n_rows"))

    buckets = rows.groupBy("s", "bucket").agg(F.ceil(F.sum("size") / block).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_source = buckets.groupBy("s").agg(F.sum("n").alias("n")).join(targets.select("s", "source_size", "target"), "s").where("n > 0 and source_size > 0")
    per_source = per_source.withColumn("slots", F.col("target") * F.col("n") / F.col("source_size"))
    every = Window.partitionBy()
    sources = F.count(F.lit(1)).over(every)
    per_source = per_source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(every) / F.greatest(F.lit(SHARD), 64 * sources))))
    per_source = per_source.withColumn("each", F.col("slots") / F.col("shards")).withColumn("part", F.col("each") - F.floor("each"))
    per_source = per_source.withColumn("lo", F.coalesce(F.sum("part").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("parts", F.sum("part").over(every))
    per_source = cut(per_source)

    shards = per_source.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    shards = shards.withColumn("rest", (F.floor((F.col("shard") + 1) * F.col("parts") + 0.5) - F.floor(F.col("shard") * F.col("parts") + 0.5)).cast("int"))
    shards = shards.withColumn("drawn", F.expr(f"case when rest < 1 then 0 else size(filter(sequence(1, rest), r -> pmod(xxhash64({seed}, shard, r), 1099511627776) / 1099511627776D * parts >= lo and pmod(xxhash64({seed}, shard, r), 1099511627776) / 1099511627776D * parts < lo + part)) end"))
    shards = shards.withColumn("count", F.floor("each") + F.col("drawn"))
    # Running sums in two steps, so that no window holds all shards of a source.
    shards = shards.withColumn("run", F.floor(F.col("shard") / RUN))
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = shards.groupBy("s", "run").agg(F.sum("count").alias("sum")).select("s", "run", F.coalesce(F.sum("sum").over(prior.partitionBy("s").orderBy("run")), F.lit(0)).alias("base"))
    shards = shards.join(runs, ["s", "run"]).withColumn("at", F.col("base") + F.coalesce(F.sum("count").over(prior.partitionBy("s", "run").orderBy("shard")), F.lit(0)))
    slots = shards.where("count > 0").select("s", "n", "shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("count") - 1)).alias("slot")).where("slot < 2 * n")
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("n")).cast("int"))
    slots = slots.withColumn("block", _permuted(F.col("slot") % F.col("n"), F.col("n"), F.xxhash64("s", "epoch", F.lit(seed))))

    filled = rows.where("size > 0").join(buckets.hint("merge"), ["s", "bucket"])
    filled = filled.select("doc_id", "source", "mark", "copy", "s", "size", "offset", "first", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("k"))
    begin = F.greatest(F.col("k") * block, F.col("offset"))
    filled = filled.select("doc_id", "source", "mark", "copy", "s", (F.col("first") + F.col("k")).alias("block"), (begin - F.col("offset")).alias("start"), (F.least((F.col("k") + 1) * block, F.col("offset") + F.col("size")) - begin).alias("words"))
    # A merge join by hint: the estimate of the exploded slots is that of the few sources they come from.
    pieces = slots.select("s", "shard", "slot", "epoch", "block").hint("merge").join(filled, ["s", "block"]).select("doc_id", "source", "mark", "copy", "shard", "slot", "epoch", "block", "start", "words")
    return rows.select("doc_id", "source", "mark", "copy", "size", "source_size", "target"), pieces


def mix_report(df: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of df; taken counts the words that the mix holds of it."""
    rows, pieces = draw(df, **options)
    key = ["doc_id", "source", "mark", "copy"]
    taken = pieces.groupBy(*key).agg(F.sum("words").alias("taken"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return rows.alias("r").join(taken.alias("t").hint("merge"), on, "left").select("r.doc_id", "r.size", "r.source_size", "r.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of text in ranges of (first, number), with the white space between neighbours as it was; gaps become a line end."""
    import re

    spans = [m.span() for m in re.finditer(WORD, text)]
    merged: list[list[int]] = []
    for a, n in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n)
        else:
            merged.append([a, a + n])
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged if a < b <= len(spans))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: for each row of df and each epoch that drew from it, a row with the drawn words in order.

    A document that an epoch draws whole keeps its text as it is. A row that nothing was drawn from, as one without words, goes.
    Null sources are one source; repeated rows are drawn from each; other columns stay, whatever their names; an empty df stays empty.
    """
    _, pieces = draw(df, id_col, text_col, source_col, **options)
    key = ("doc_id", "source", "mark", "copy")
    mine, theirs = {c: free_name(df, f"mix_{c}") for c in key}, {c: free_name(df, f"plan_{c}") for c in key}
    ranges = free_name(df, "mix_ranges")
    plan = pieces.groupBy(*key, "epoch").agg(F.collect_list(F.struct("start", "words")).alias(ranges)).select(*[F.col(c).alias(theirs[c]) for c in key], ranges)
    keyed = df.select("*", F.col(id_col).cast("long").alias(mine["doc_id"]), F.col(source_col).cast("string").alias(mine["source"]), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(mine["mark"]))
    keyed = keyed.withColumn(mine["copy"], F.row_number().over(Window.partitionBy(*[mine[c] for c in key[:3]]).orderBy(F.lit(0))))
    on = reduce(Column.__and__, [F.col(mine[c]).eqNullSafe(F.col(theirs[c])) for c in key])
    joined = keyed.join(plan.hint("merge"), on).select(*columns_of(df), ranges)
    return replace_texts(joined, text_col, length_col, lambda t, r: cut_words(t or "", [(x["start"], x["words"]) for x in r]), drop=ranges)
