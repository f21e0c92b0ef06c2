"""MinHash near-dedup with HyperMinHash registers.

Each register keeps the leading-zero count and a few mantissa bits of a minimum. A long document takes one minimum a bucket
of the hash range; a document too short to fill the buckets takes one minimum a hash function; a size between takes both, so
that any two documents that could be linked share a form. Five registers make a band. Documents with equal shingle sets
are one class, and only class representatives are banded. In each band bucket every member meets the bucket's smallest
member; a collision-corrected estimate drops pairs that can't reach the threshold; the rest are confirmed on full shingle
sets. Where a bucket still holds several components, its pairs across components that share a second band are confirmed too,
in buckets of every size.

Joins by key are merge joins by hint: estimates of exploded rows are too low to let them decide on a broadcast. Texts are
shuffled for each confirmation; what a phase leaves behind is released before the next begins.

The threshold sets the band plan: as many rows a band as keep the chance that a linked pair shares fewer than two bands below
MISS (30 bands of 4 rows at 0.85 and at 0.80). The least estimate lies seven deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import arrow_schema, free_name, map_rows, release, spread
from sparkquiver.llm.shingles import mix, shingle_sets
from sparkquiver.operators.components import connected_components, cut

#: Registers, registers a band unless a plan says otherwise, and bits of mantissa.
REGISTERS, ROWS, MANTISSA = 120, 4, 6
#: Chance that a pair at the threshold shares fewer than two bands.
MISS = 5e-6
#: Per cent of similarity from which documents are linked, unless a caller gives another.
PER_CENT = 85
#: Shingles from which buckets are filled well enough; documents up to SHORT / (threshold - 0.02) take hash functions as well.
SHORT = 1024
#: Members of one representative that a task confirms at a time.
STAR = 512
EMPTY = 0xFFF
_EDGE = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], dtype=np.uint64)
_A = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_C = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _compress(minimum: np.ndarray) -> np.ndarray:
    """12 bits a register: 6 of leading zeros, 6 of mantissa."""
    m, e = np.frexp(np.maximum(minimum, np.uint64(1)).astype(np.float64))
    lead = np.clip(64 - e, 0, 62).astype(np.int64)
    return (lead << MANTISSA) | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64)


def band_plan(per_cent: int) -> tuple[int, float]:
    """(rows a band, least estimate) for a threshold."""
    t = per_cent / 100
    for rows in (5, 4, 3, 2, 1):
        share, bands = t**rows, REGISTERS // rows
        none = (1 - share) ** bands
        if none + bands * share * (1 - share) ** (bands - 1) < MISS:
            return rows, t - 7.06 * sqrt(t * (1 - t) / REGISTERS)
    raise ValueError(f"no band plan for {per_cent} %")


def _bands(registers: np.ndarray, rows: int = ROWS) -> list[int]:
    shift = np.arange(rows, dtype=np.int64) * 12
    return (registers.reshape(-1, rows) << shift).sum(axis=1).tolist()


def bucket_bands(u: np.ndarray, rows: int = ROWS) -> list[int]:
    """Bands of the least hash in each of REGISTERS equal ranges; u is sorted."""
    at = np.searchsorted(u, _EDGE)
    end = np.append(at[1:], len(u))
    value = u[np.minimum(at, len(u) - 1)] - _EDGE
    return _bands(np.where(at < end, _compress(value << np.uint64(6)), EMPTY), rows)


def function_bands(u: np.ndarray, rows: int = ROWS) -> list[int]:
    """Bands of the least value of each of REGISTERS hash functions."""
    best = None
    for i in range(0, len(u), 512):
        low = (u[None, i : i + 512] * _A[:, None] + _C[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return _bands(_compress(best), rows)


def describe(df: DataFrame, id_col: str, text_col: str, per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, short, long): the key stands for the whole shingle set."""
    rows, most = band_plan(per_cent)[0], SHORT / (per_cent / 100 - 0.02)

    def make():
        def f(ids: list, texts: list) -> Iterator[tuple]:
            for i, u in zip(ids, shingle_sets(texts)):
                n = len(u)
                if not n:
                    yield i, 0, 0, 0, None, None
                    continue
                a = int(mix(u ^ np.uint64(0x243F6A8885A308D3)).sum().view(np.int64))
                b = int(mix(u ^ np.uint64(0x13198A2E03707344)).sum().view(np.int64))
                yield i, n, a, b, function_bands(u, rows) if n <= most else None, bucket_bands(u, rows) if n >= SHORT else None

        return f

    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(spread(one), ["doc_id", "text"], "doc_id long, n_shingles long, key_a long, key_b long, short array<long>, long array<long>", make)


def estimate_jaccard(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Jaccard estimates of rows of bands, corrected for registers that agree by chance (HyperMinHash, Yu and Weber)."""
    shift = np.arange(rows, dtype=np.int64) * 12
    p = ((x[:, :, None] >> shift) & EMPTY).reshape(len(x), -1)
    q = ((y[:, :, None] >> shift) & EMPTY).reshape(len(y), -1)
    used = ((p != EMPTY) | (q != EMPTY)).sum(axis=1)
    same = ((p == q) & (p != EMPTY)).sum(axis=1)
    ratio = np.maximum(n, m) / np.minimum(n, m)
    chance = 0.169919487159739093975 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1)


def _estimated(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose estimate reaches the least of the threshold."""
    rows, least = band_plan(per_cent)
    sig = classes.select("rep", F.struct("n_shingles", "short", "long").alias("s"))
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("s").alias("p")).hint("merge"), "a").join(sig.select(F.col("rep").alias("b"), F.col("s").alias("q")).hint("merge"), "b")
    short = F.col("p.short").isNotNull() & F.col("q.short").isNotNull()
    both = both.select("a", "b", F.col("p.n_shingles").alias("n"), F.col("q.n_shingles").alias("m"), F.when(short, F.col("p.short")).otherwise(F.col("p.long")).alias("x"), F.when(short, F.col("q.short")).otherwise(F.col("q.long")).alias("y"))
    both = both.where(f"x is not null and y is not null and 100 * least(n, m) >= {per_cent} * greatest(n, m)")
    schema = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, REGISTERS // rows) for i in (4, 5))
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            near = pa.array(estimate_jaccard(x, y, n, m, rows) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], schema=schema)

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet the threshold. docs: (doc_id, text).

    The pairs of one a are dealt over tasks, STAR to each; a task keeps one set of a and streams the others past it.
    """
    dealt = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / STAR)).cast("int").alias("part"))
    rows = dealt.withColumn("head", F.lit(False)).unionByName(dealt.select("a", F.col("a").alias("b"), "part", F.lit(True).alias("head")).distinct())
    rows = rows.hint("merge").join(docs.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "part", "head", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("head").desc(), "b")

    def make():
        heads: list[np.ndarray] = []
        now = None

        def f(a, part, head, b, text) -> Iterator[tuple]:
            nonlocal now
            for i, (x, u) in enumerate(zip(zip(a, part), shingle_sets(text))):
                if x != now:
                    heads.clear()
                    now = x
                if head[i]:
                    heads.append(u)
                    continue
                for h in heads:
                    both = len(np.intersect1d(h, u, assume_unique=True))
                    if both and 100 * both >= per_cent * (len(h) + len(u) - both):
                        yield a[i], b[i]
                        break

        return f

    return map_rows(rows, ["a", "part", "head", "b", "text"], "a long, b long", make)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df; documents at per_cent of similarity or more are linked.

    Null or empty text, or text of white space only: no shingles, linked with nothing, kept. A null id is never linked; its
    component is null and it is kept. Rows that share an id are one document: they share a component.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = cut(describe(df, id_col, text_col, per_cent))
    classes = described.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("short").alias("short"), F.first("long").alias("long"))
    classes = cut(classes)
    described = cut(described.select("doc_id", "n_shingles", "key_a", "key_b"))
    release(df.sparkSession)
    explode = lambda c, at: classes.where(F.col(c).isNotNull()).select("rep", F.posexplode(c).alias("band", "key")).withColumn("band", F.col("band") + at)
    buckets = explode("short", 0).unionByName(explode("long", REGISTERS // band_plan(per_cent)[0]))
    shared = buckets.groupBy("band", "key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot <> top").drop("top")
    multi = cut(buckets.join(shared.hint("merge"), ["band", "key"]))
    first = cut(multi.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    near = cut(_estimated(first, classes, per_cent))
    release(df.sparkSession)
    links = cut(confirmed(near, docs, per_cent))
    release(df.sparkSession)
    found = cut(connected_components(links))
    release(df.sparkSession)

    label = found.select(F.col("node").alias("rep"), "component")
    here = multi.join(label.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = here.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi")
    here = cut(here.join(mixed.hint("merge"), ["band", "key"]))
    second = here.join(buckets.select("rep", F.col("band").alias("band2"), F.col("key").alias("key2")).hint("merge"), "rep").where("band < band2")
    on = ["band", "key", "band2", "key2"]
    left = second.select(*on, F.col("rep").alias("a"), F.col("component").alias("p"))
    right = second.select(*on, F.col("rep").alias("b"), F.col("component").alias("q"))
    rest = left.join(right.hint("merge"), on).where("a < b and p <> q").select("a", "b").distinct().join(first.hint("merge"), ["a", "b"], "left_anti")
    near = cut(_estimated(rest, classes, per_cent))
    release(df.sparkSession)
    more = cut(confirmed(near, docs, per_cent))
    release(df.sparkSession)
    every = links.unionByName(more)
    final = connected_components(every)
    by_class = classes.select("key_a", "key_b", "n_shingles", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = described.join(by_class, ["key_a", "key_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """df without the rows whose document isn't the smallest of its component; of rows that share an id and are kept, all stay.

    Rows with a null id, or with no words, stay. Columns come back as they are, whatever their names; an empty df stays empty.
    """
    gone = free_name(df, "gone")
    ids = cut(near_duplicates(df, id_col, text_col, per_cent).where("not kept").select(F.col("doc_id").alias(gone)).distinct())
    release(df.sparkSession)
    return df.join(ids.hint("merge"), F.col(id_col) == F.col(gone), "left_anti")
