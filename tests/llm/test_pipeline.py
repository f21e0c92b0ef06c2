from collections import Counter

import corpus_pipeline
from sparkquiver.llm import neardup, quality, secrets
from tests.llm import brute
from tests.llm.conftest import SCHEMA
from tests.llm.test_quality import CLEAN, JUNK

WORDS = CLEAN.split()


def clean(i):
    return " ".join(f"{w} d{i}n{k}" if k % 3 == 0 else w for k, w in enumerate(WORDS))


def corpus(spark):
    rows = [(i, clean(i), "en", f"s{i % 3}", len(clean(i))) for i in range(24)]
    rows += [(100 + i, clean(i).upper() if i % 2 else clean(i) + " tail", "en", "s1", 0) for i in range(4)]
    rows += [(200, JUNK, "en", "s1", 1), (201, None, "en", "s1", 0), (202, "", None, None, 0), (203, clean(90) + " password=abcdef123456", "en", None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_stage(spark, tmp_path):
    docs, out = corpus(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
        if name != "pack_windows":
            assert docs.dtypes == corpus(spark).dtypes
    good = {r["doc_id"] for r in out["quality_rules"]}
    assert good == set(range(24)) | {100, 102, 203}  # text in capitals alone is far from its language
    one = {r["doc_id"] for r in out["near_dedup"]}
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in out["quality_rules"]])
    assert one == {i for i, (_, _, kept) in want.items() if kept} == set(range(24)) | {203}
    masked = {r["doc_id"]: r["text"] for r in out["secret_scan"]}
    assert masked[203].endswith("[SECRET]") and masked == {r["doc_id"]: secrets.redact(r["text"]) for r in out["near_dedup"]}
    words = Counter()
    for r in out["source_mix"]:
        got = brute.WORD.findall(r["text"])
        assert set(got) <= set(brute.WORD.findall(masked[r["doc_id"]]))
        words[r["doc_id"]] += len(got)
    assert all(n <= 2 * len(brute.WORD.findall(masked[i])) for i, n in words.items())
    tokens = Counter()
    for r in out["pack_windows"]:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == set(words)


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(range(24)) | {203}


def test_stages_of_nothing(spark, empty, tmp_path):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_extra_columns_with_clashing_names(spark):
    from tests.llm.conftest import clashing

    df = clashing(corpus(spark))
    for f in (quality.keep_good, neardup.keep_one, secrets.redact_secrets):
        assert f(df).columns == df.columns
