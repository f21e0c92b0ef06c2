"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A unit vector x of D coordinates is rotated at random and kept as the signs of its coordinates (a code c, a vertex of the unit
cube scaled to length 1) with the correction factor <c, x>. For another vector q, <c, q> / <c, x> is an unbiased estimate of
<x, q>; at a cosine t it is off by about sqrt(1 / f^2 - 1) * sqrt(1 - t^2) / sqrt(D - 1) for a factor f (RaBitQ, Gao and Long
2024). Here a class of equal vectors stores its codes and factors under enough rotations for CODE_BITS bits, and its rotated
coordinates in a byte each, rounded at random, which keep estimates unbiased. A pair is estimated both ways.

1. Pairs that share a band of code bits, and whose first WIDE bits don't already lie beyond SIGMA deviations, are candidates.
2. The estimate of each, from codes and factors alone, rejects it if it lies SIGMA deviations below the threshold.
3. Only the pairs that are left have their vectors joined, and are recomputed exactly.

Vectors within half the threshold's angle of one root are a core: any two of them are linked, by the triangle inequality, so
their links are counted and not emitted; a cluster of copies with noise costs a row a member, not a row a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import arrow_schema, map_rows, release
from sparkquiver.operators.components import connected_components, cut

#: Chance that a pair at the threshold shares no band.
MISS = 1e-5
#: Deviations of the bounds.
SIGMA = 5.0
#: Bits of the code that goes along with each band; bits of the stored codes at least.
WIDE, CODE_BITS = 128, 256
#: Steps of a rotated coordinate's byte, in deviations of a coordinate: it spans four of them on either side.
STEP = 4 / 127
#: Kept off the core's half angle against rounding.
SLACK = 1e-9


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits a band, bands): bits follow log2 of the rows, so that a bucket of unlike vectors stays of constant size."""
    bits = min(48, max(12, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def codes(unit: np.ndarray, n_bits: int, first_seed: int) -> np.ndarray:
    """Signs of enough random rotations of each row of unit, the first n_bits of them."""
    dim = unit.shape[1]
    parts = [unit @ rotation(dim, first_seed + i).T > 0 for i in range(-(-n_bits // dim))]
    return np.concatenate(parts, axis=1)[:, :n_bits]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as signed integers."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(unit: np.ndarray, seed: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, factors, bytes) of each row of unit: packed signs and <code, x> under each rotation, and the rotated coordinates
    of all of them in a byte each, rounded at random (the same way for the same vector, so that reruns agree)."""
    n, dim = unit.shape
    turned = np.stack([unit @ rotation(dim, seed + i).T for i in range(-(-CODE_BITS // dim))], axis=1)
    factor = np.abs(turned).sum(axis=2) / math.sqrt(dim)
    flat = turned.reshape(n, -1)
    scaled = flat * (math.sqrt(dim) / STEP)
    # A coordinate's own low bits serve as its random number.
    dither = (scaled.astype(np.float32).view(np.uint32) * np.uint32(2654435761) >> np.uint32(8)).astype(np.float64) / (1 << 24)
    return np.packbits(flat > 0, axis=1), factor, np.clip(np.floor(scaled + dither), -127, 127).astype(np.int8)


def estimate(c: np.ndarray, f: np.ndarray, q: np.ndarray, dim: int) -> np.ndarray:
    """Inner products estimated from codes c and factors f of the one side and coordinate bytes q of the other."""
    turns = f.shape[1]
    signs = np.unpackbits(c, axis=1, count=turns * dim).astype(np.int16) * 2 - 1
    dot = (signs * q).reshape(len(c), turns, dim).sum(axis=2, dtype=np.int64) * (STEP / dim)
    return (dot / f).mean(axis=1)


def least_estimate(f: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """SIGMA deviations below the threshold, for estimates with factors f; minus infinity where there are too few coordinates."""
    turns = f.shape[1]
    if dim < 8:
        return np.full(len(f), -np.inf)
    off = (1 / f**2 - 1).clip(0) * (1 - threshold**2) / (dim - 1) + (STEP / f) ** 2 / (4 * dim)
    return threshold - SIGMA * np.sqrt(off.sum(axis=1)) / turns


def undecided(a: tuple, b: tuple, dim: int, threshold: float) -> np.ndarray:
    """Which pairs of sketches may reach the threshold; each side estimates with the other, and both must leave it open."""
    return (estimate(a[0], a[1], b[2], dim) >= least_estimate(a[1], dim, threshold)) & (estimate(b[0], b[1], a[2], dim) >= least_estimate(b[1], dim, threshold))


def _usable(v: list | None) -> np.ndarray | None:
    """v as a double array, or None where it can't be linked with anything."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, dtype=np.float64)
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    return a if top > 0 else None


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=-1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=-1, keepdims=True))


def near_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df.

    A vector that is null, empty or zero, or that holds a null or non-finite component, links with nothing; vectors of different
    lengths don't link. Rows with equal vectors are one class, which counts as many links as it has other rows. Rows that
    share an id count as that many vectors. A null id is never linked: its component is null and it is kept. An empty df gives
    no row; its other columns, whatever their names, don't matter.
    """
    one = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def clean():
        def f(ids: list, vectors: list) -> Iterator[tuple]:
            for i, v in zip(ids, vectors):
                a = _usable(v)
                yield (i, None) if a is None or i is None else (i, a.tolist())

        return f

    rows = map_rows(one, ["vec_id", "v"], "vec_id long, v array<double>", clean)
    rows = rows.withColumn("ka", F.xxhash64("v")).withColumn("kb", F.xxhash64(F.reverse("v"), F.lit(1)))
    classes = rows.where("v is not null").groupBy("ka", "kb").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
    # Numbered, and written with the numbers, so that they are keys without collisions.
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    rows = cut(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("ka")).alias("ka"), F.when(F.col("v").isNotNull(), F.col("kb")).alias("kb")))
    bits, bands = band_plan(classes.count(), threshold)

    def banded():
        def f(ids: list, vectors: list) -> Iterator[tuple]:
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                unit = _unit(np.array([vectors[k] for k in at]))
                wide = codes(unit, WIDE, 100_000)
                low, high = _words(wide[:, :64]), _words(wide[:, 64:])
                every = codes(unit, bits * bands, 0)
                keys = [_words(every[:, b * bits : (b + 1) * bits]) for b in range(bands)]
                code, factor, coordinate = sketch(unit)
                for r, k in enumerate(at):
                    yield ids[k], dim, [int(x[r]) for x in keys], int(low[r]), int(high[r]), code[r].tobytes(), factor[r].tolist(), coordinate[r].tobytes()

        return f

    marked = cut(map_rows(classes.select("cls", "v"), ["cls", "v"], "cls long, dim int, keys array<long>, low long, high long, code binary, factor array<double>, coordinate binary", banded))
    buckets = marked.select("cls", "dim", "low", "high", F.posexplode("keys").alias("band", "key"))
    p = math.acos(threshold) / math.pi
    far = math.floor(WIDE * p + SIGMA * math.sqrt(WIDE * p * (1 - p)))
    near = F.expr("bit_count(la ^ lb) + bit_count(ha ^ hb)") <= far
    on = ["dim", "band", "key"]

    # Every member of a bucket meets its least one, for cores; the others of a bucket meet across cores.
    pivot = buckets.groupBy(*on).agg(F.min(F.struct("cls", "low", "high")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivot = pivot.select(*on, F.col("p.cls").alias("a"), F.col("p.low").alias("la"), F.col("p.high").alias("ha"))
    member = buckets.select(*on, F.col("cls").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    star = cut(exact(pivot.hint("merge").join(member.hint("merge"), on).where("a < b").where(near).select("a", "b").distinct(), marked, classes, threshold))
    core = cut(cores(star, threshold))
    release(df.sparkSession)
    placed = marked.join(core.hint("merge"), "cls", "left").select("cls", "dim", "low", "high", "core", F.posexplode("keys").alias("band", "key"))
    left = placed.select(*on, F.col("cls").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("core").alias("p"))
    right = placed.select(*on, F.col("cls").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("core").alias("q"))
    pairs = left.join(right.hint("merge"), on).where("a < b and not coalesce(p = q, false)").where(near).select("a", "b").distinct()
    links = cut(exact(pairs, marked, classes, threshold).select("a", "b"))
    release(df.sparkSession)
    return _result(rows, classes, links, core)


def exact(pairs: DataFrame, marked: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) at the threshold or above. marked has the classes' sketches, classes their vectors."""
    return recomputed(possible(pairs, marked, threshold), classes, threshold)


def possible(pairs: DataFrame, marked: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that their estimates leave open, by codes and factors alone."""
    stored = marked.select("cls", "dim", F.struct("code", "factor", "coordinate").alias("s"))
    both = pairs.join(stored.select(F.col("cls").alias("a"), "dim", F.col("s").alias("x")).hint("merge"), "a").join(stored.select(F.col("cls").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    schema = arrow_schema("a long, b long")

    def side(column: pa.Array, at: np.ndarray, dim: int) -> tuple:
        turns = -(-CODE_BITS // dim)
        code, factor, coordinate = (column.field(k).take(pa.array(at)) for k in range(3))
        grid = lambda x, kind: np.frombuffer(b"".join(x.to_pylist()), kind).reshape(len(at), -1)
        return grid(code, np.uint8), factor.flatten().to_numpy(zero_copy_only=False).reshape(-1, turns), grid(coordinate, np.int8)

    def run(batches):
        for batch in batches:
            a, b, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for dim in map(int, np.unique(dims)):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, max(1, len(at) * max(dim, CODE_BITS) // 4_000_000)):
                    ok = part[undecided(side(batch.column(3), part, dim), side(batch.column(4), part, dim), dim, threshold)]
                    yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=schema)

    return both.select("a", "b", "dim", "x", "y").mapInArrow(run, "a long, b long")


def recomputed(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) whose vectors reach the threshold in double precision."""
    vectors = classes.select("cls", "v")
    both = pairs.join(vectors.select(F.col("cls").alias("a"), F.col("v").alias("x")).hint("merge"), "a").join(vectors.select(F.col("cls").alias("b"), F.col("v").alias("y")).hint("merge"), "b")
    schema = arrow_schema("a long, b long, cosine double")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x, y = batch.column(2), batch.column(3)
            size = np.diff(x.offsets.to_numpy())
            fx, fy = x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                span = start[at][:, None] + np.arange(dim)
                c = cosine(fx[span], fy[span])
                ok = c >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(a[at[ok]]), pa.array(b[at[ok]]), pa.array(c[ok])], schema=schema)

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cosine double")


def cosine(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    u, w = u / np.abs(u).max(axis=1, keepdims=True), w / np.abs(w).max(axis=1, keepdims=True)
    return (u * w).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (w * w).sum(axis=1))


def cores(star: DataFrame, threshold: float) -> DataFrame:
    """(cls, core): members of cores, roots included, from links (a, b, cosine). A member lies within half the threshold's angle
    of its root, and no root is a member elsewhere, so any two of one core lie within the whole angle."""
    close = star.where(F.col("cosine") >= math.cos(math.acos(threshold) / 2) + SLACK).select("a", "b")
    roots = close.select(F.col("a").alias("cls")).distinct().join(close.select(F.col("b").alias("cls")).distinct().hint("merge"), "cls", "left_anti")
    member = close.join(roots.select(F.col("cls").alias("a")).hint("merge"), "a").groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("core"))
    return member.unionByName(member.select(F.col("core").alias("cls"), "core").distinct())


def _result(rows: DataFrame, classes: DataFrame, links: DataFrame, core: DataFrame) -> DataFrame:
    """Links within a core are counted by its weight; the others come in links."""
    sizes = classes.select("cls", "size")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(sizes.select(F.col("cls").alias("b"), "size").hint("merge"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("others"))
    weight = core.join(sizes.hint("merge"), "cls").groupBy("core").agg(F.sum("size").alias("weight"))
    within = core.join(weight.hint("merge"), "core").select("cls", "weight")
    found = connected_components(links.unionByName(core.select(F.col("core").alias("a"), F.col("cls").alias("b"))))
    label = found.join(classes.select(F.col("cls").alias("node"), "rep").hint("merge"), "node").select("node", "component", "rep")
    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    label = label.join(least.hint("merge"), "component").select(F.col("node").alias("cls"), "least")
    by_class = classes.select("cls", "ka", "kb", "rep", "size").join(degree.hint("merge"), "cls", "left").join(label.hint("merge"), "cls", "left").join(within.hint("merge"), "cls", "left")
    n = F.coalesce("weight", "size") - 1 + F.coalesce("others", F.lit(0))
    by_class = by_class.select("ka", "kb", n.alias("n"), F.coalesce("least", "rep").alias("least"))
    out = rows.join(by_class.hint("merge"), ["ka", "kb"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
