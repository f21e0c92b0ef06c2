import re

from sparkquiver.llm import quality
from tests.llm import brute
from tests.llm.conftest import SCHEMA, clashing

CLEAN = "the quick brown fox of the hill and a dog in that town is known for it to be kind and the day was long as of now by the sea with a friend on the way to a place in the north that is old "
JUNK = " ".join(f"w{i}$$$ ###{i * 7} %%%&" for i in range(60))


def test_measures(docs, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.quality(clashing(docs)).collect()}
    assert got == {i: brute.quality(t) for i, t in texts.items()}


def corpus(spark):
    words = CLEAN.split()
    rows = [(i, " ".join(f"{w} v{i}{'xyz'[k % 3]}{k}" if k % 3 == 0 else w for k, w in enumerate(words)), "en", "s", 1) for i in range(30)] + [(99, JUNK, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_junk_goes_and_clean_stays(spark):
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(corpus(spark)).collect()}
    assert verdict == {i: True for i in range(30)} | {99: False}
    assert sorted(r["doc_id"] for r in quality.keep_good(clashing(corpus(spark))).collect()) == list(range(30))


def test_native_plan(docs):
    whole = quality.judge(quality.base_measures(docs, keep=("doc_id", "lang")), "lang")
    for df in (quality.base_measures(docs), whole):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_verdicts_against_a_plain_version(docs, documents):
    """Histograms, their languages' means and Jensen-Shannon distances, one document at a time."""
    import math

    def shares(counts, total):
        p = [c / max(total, 1) for c in counts]
        return [*p, max(0.0, 1 - sum(p))]

    def distance(p, q):
        term = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(term(a, b) + term(b, a) for a, b in zip(p, q)) / 2))

    made = {}
    for i, t, lang, *_ in documents:
        words = brute.WORD.findall(t or "")
        dense = "".join(words)
        made[i] = (lang, shares([len(re.findall(rx, dense)) for rx in quality.CLASSES.values()], len(dense)), shares([words.count(w) for w in quality.COMMON], len(words)), brute.quality(t)[5])
    mean = {}
    for lang in {x[0] for x in made.values()}:
        of = [x for x in made.values() if x[0] == lang and not x[3]]
        if of:
            mean[lang] = [[sum(c) / len(of) for c in zip(*[x[k] for x in of])] for k in (1, 2)]
    for r in quality.quality(docs).collect():
        lang, p, q, failed = made[r["doc_id"]]
        if lang not in mean:
            assert r["kept"] is (not failed) and r["char_distance"] is None
            continue
        c, w, far = distance(p, mean[lang][0]), distance(q, mean[lang][1]), distance([0.0] * len(quality.COMMON) + [1.0], mean[lang][1])
        assert abs(r["char_distance"] - c) < 1e-9 and abs(r["word_distance"] - w) < 1e-9
        assert r["kept"] is (not failed and c <= quality.MAX_CHAR_DISTANCE and w <= quality.MAX_WORD_SHARE * far)


def test_empty_and_repeated(spark, empty):
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0
    df = spark.createDataFrame([(1, CLEAN * 2, None, None, None)] * 3, SCHEMA)
    assert quality.quality(df).count() == 3
