import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquiver.llm import embeddings, neardup
from sparkquiver.llm.shingles import shingle_sets
from tests.llm import brute
from tests.llm.conftest import SCHEMA, clashing


def test_components(docs, documents, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(clashing(docs)).collect()}
    assert got == brute.near_duplicates([(r[0], r[1]) for r in documents])
    assert sum(not k for *_, k in got.values()) >= 8


def test_shingles_of_long_and_odd_texts():
    rng = random.Random(2)
    for t in ("a" * 3_000_000, " ".join(rng.choices("abcdefgh", k=700_000)), "x\x0by\x0cz\r\nq\tw é", "é " * 9, "\x1c\x85 \xa0"):
        assert len(shingle_sets([t, "b"])[0]) == len(brute.shingles(t))
    a, b = shingle_sets(["The Quick brown fox jumps", "the  quick\nBROWN fox jumps "])
    assert a.tolist() == b.tolist()
    a, b = shingle_sets(["ab c", "a bc"])
    assert a.tolist() != b.tolist()


def test_estimates():
    rng = np.random.default_rng(1)
    for n, share in ((3000, 0.9), (400, 0.8), (5000, 0.5)):
        pool = rng.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        common = round(2 * n * share / (1 + share))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        bands = neardup.bucket_bands if n >= neardup.SHORT else neardup.function_bands
        one = lambda v: np.array([bands(v)], dtype=np.int64)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(neardup.estimate_jaccard(one(x), one(y), np.array([n]), np.array([n]))[0] - true) < 0.2


def test_edge_rows(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    same = "one two three four five six seven"
    df = spark.createDataFrame([(5, same, None, None, None), (5, same, None, None, None), (3, same.upper(), None, None, None), (None, same, None, None, None), (7, None, None, None, None), (8, "", None, None, None), (9, "solo", None, None, None), (2, "SOLO", None, None, None)], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (7, 7, True), (8, 8, True), (9, 2, False), (2, 2, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in neardup.keep_one(clashing(df)).collect()) == ["2", "3", "7", "8", "None"]


def test_many_families(spark):
    """Families whose members differ by up to a fifth, so that buckets hold several components."""
    rng = random.Random(8)
    rows = []
    for f in range(6):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(120)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(w), "en", "s", 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.near_duplicates([(r[0], r[1]) for r in rows])


def test_pipeline_drops_copies_from_80_per_cent(spark, tmp_path):
    import corpus_pipeline

    rng, rows = random.Random(4), []
    for f, (n, most) in enumerate([(200, 6), (1250, 36), (1300, 36), (1350, 36), (3000, 80)]):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(10):
            w = list(base)
            for i in range(most * k // 10):  # changed words at distance, each in five shingles
                w[8 + i * (n // most - 1)] = f"z{rng.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(w + base[: n // 9] * (k == 5)), "en", "s", 1))
    texts = [(r[0], r[1]) for r in rows]
    a, b = brute.shingles(rows[0][1]), brute.shingles(rows[7][1])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame(rows, SCHEMA)
    for per_cent in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, per_cent=per_cent).collect()}
        assert got == brute.near_duplicates(texts, per_cent)
    pair = df.where("doc_id in (0, 7)")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, pair, str(tmp_path)).collect()] == [0]
    assert neardup.near_duplicates(pair).where("kept").count() == 2


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 12] * (1 + i) + rng.standard_normal(64) * 0.02 * i * (1 + i)).tolist()) for i in range(48)]
    rows += [(200, None), (201, [0.0] * 64), (202, [float("nan")] * 64), (203, [None] * 64), (204, [float("inf")] + [1.0] * 63), (205, []), (206, [1.0] * 8), (207, [2.0] * 8), (208, rows[5][1]), (208, rows[5][1]), (209, [1e300] * 64), (210, [1e-300] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as a", "'y' as rep", "1 as label")
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]

    def linked(u, w):
        if len(u) != len(w):
            return False
        u, w = u / np.abs(u).max(), w / np.abs(w).max()
        return u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.95

    links = [(i, j) for x, (i, u) in enumerate(ok) for j, w in ok[x + 1 :] if linked(u, w)]
    comp = brute.components({i for i, _ in rows}, links)
    degree = {}
    for i, j in links:
        degree[i] = degree.get(i, 0) + 1
        degree[j] = degree.get(j, 0) + 1
    degree[208] //= 2
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {(i, degree.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def pairs_at(cosine, n=4000, dim=64, seed=7):
    rng = np.random.default_rng(seed)
    x = embeddings._unit(rng.standard_normal((n, dim)))
    y = rng.standard_normal((n, dim))
    y = embeddings._unit(y - (x * y).sum(axis=1)[:, None] * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_codes_are_unbiased_and_bounded(dim):
    for cosine in (0.3, 0.8, 0.95):
        x, q = pairs_at(cosine, dim=dim)
        a, b = embeddings.sketch(x), embeddings.sketch(q)
        assert abs(embeddings.estimate(a[0], a[1], b[2], dim).mean() - cosine) < 0.01
    keep = {c: embeddings.undecided(*(embeddings.sketch(v) for v in pairs_at(c, dim=dim)), dim, 0.95).mean() for c in (0.5, 0.8, 0.85, 0.9, 0.95, 0.97)}
    assert keep[0.95] > 0.999 and keep[0.97] == 1.0
    if dim >= 64:
        assert keep[0.5] == 0 and keep[0.8] < 0.05 and keep[0.85] < 0.3 and (keep[0.8] + keep[0.85] + keep[0.9]) / 3 < 0.5


def test_estimates_decide_which_vectors_are_joined(spark):
    """Of pairs that share a band, the estimates reject most of those at 0.80 to 0.90 before a vector is read."""
    x, y = pairs_at(0.85, n=300)
    u, w = pairs_at(0.96, n=50, seed=8)
    vectors = [*x, *y, *u, *w]
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "cls long, v array<double>")
    sketches = embeddings.sketch(np.array(vectors))
    marked = spark.createDataFrame([(i, 64, bytearray(c.tobytes()), f.tolist(), bytearray(q.tobytes())) for i, (c, f, q) in enumerate(zip(*sketches))], "cls long, dim int, code binary, factor array<double>, coordinate binary")
    pairs = spark.createDataFrame([(i, 300 + i) for i in range(300)] + [(600 + i, 650 + i) for i in range(50)], "a long, b long")
    left = embeddings.possible(pairs, marked, 0.95)
    assert "cls" not in left.columns and left.where("a >= 600").count() == 50 and left.where("a < 600").count() < 90
    assert embeddings.exact(pairs, marked, classes, 0.95).count() == 50


def test_a_tight_cluster_costs_no_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2, 64))
    rows = [(i, (base[i % 2] + rng.standard_normal(64) * 0.02).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    kept = embeddings.exact

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return kept(pairs, *rest)

    embeddings.exact = counted
    try:
        got = {(r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    finally:
        embeddings.exact = kept
    assert got == {(149, 0), (149, 1)} and sum(seen) < 10_000  # all pairs would be 22,350


def test_names_that_clash(spark):
    from sparkquiver.llm import mixing, quality, secrets

    rows = [(1, "a b c d e f " * 20, "en", "s", 5), (2, "a b c d e f " * 20, "en", "s", 5), (3, "Bearer qZ8-r7tYw2Lk09sXvB4nM1 x", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("gone", "_gone", "key_id", "_key_id", "_key_text", "key_lang", "bad_key_id", "_source", "_id", "_mark", "_copy", "_ranges", "mix_ranges", "mix_doc_id", "plan_copy", "dotted.name", "back`tick", "text_", "m", "b")
    for n in names:
        df = df.withColumn(n, F.lit("keepme"))
    df = df.withColumn("big", F.when(F.col("doc_id") == 1, F.lit((1 << 62) + 1)))
    for f in (quality.keep_good, neardup.keep_one, secrets.redact_secrets, mixing.mix_documents):
        out = f(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert all(r[n] == "keepme" for r in out.collect() for n in names)
        assert all(r["big"] in (None, (1 << 62) + 1) for r in out.collect())
    assert neardup.keep_one(df).count() == 2
