"""Quality rules by distribution divergence, in DataFrame functions alone.

Two histograms of a document, of character classes and of common words, are compared with its language's reference, the mean
of the histograms of all documents of that language that pass the base rules, by Jensen-Shannon distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.functions.text import let
from sparkquiver.llm.common import columns_of, free_name, spread
from sparkquiver.operators.components import cut

_SPACES = "[\\x20\\x09-\\x0D]"
_NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Character classes; what is in none of them, and no white space, is a class of its own.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "symbol": SYMBOLS, "stop": "[.,;:!?'\"()-]", "beyond": "[^\\x00-\\x7F]"}
COMMON = "the of and to in a is that it for de la le et les des un que en der die und den von zu das mit el y los as by".split()
#: Words from which a verdict by divergence is given; base rules reject shorter ones.
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
#: Of the distance that a document without any common word has.
MAX_WORD_SHARE = 0.95


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms; null where one is."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x) / 2))


def base_measures(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts of the classes and common words.

    Lower-case letters and white space go first; the other classes are counted in the little that is left. Windows of three
    words are hashed once; only a text whose hashes repeat has them sorted and its words compared.
    """
    t = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    t = t.withColumn("_words", F.array_remove(F.split("_text", f"{_SPACES}+"), "")).withColumn("_rest", F.regexp_replace("_text", "[a-z]+", ""))
    t = t.withColumn("_n", F.size("_words")).withColumn("_dense", F.regexp_replace("_rest", f"{_SPACES}+", "")).withColumn("_common", F.filter("_words", lambda w: w.isin(*COMMON)))
    window = "xxhash64(w, get(_words, i + 1), get(_words, i + 2))"
    t = t.withColumn("_h", F.expr(f"case when _n < 4 then cast(array() as array<bigint>) else slice(transform(_words, (w, i) -> {window}), 1, _n - 2) end"))
    t = t.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h")).withColumn("_b", F.ceil(F.log2(F.col("_n") + 2)).cast("int"))
    # Each hash as one long with its position in the low bits, sorted, so that equal windows are neighbours.
    t = t.withColumn("_s", F.expr("case when _again then sort_array(transform(_h, (h, i) -> shiftleft(h, _b) | cast(i as bigint))) end"))
    at = lambda k: f"cast(_s[{k}] & (shiftleft(1L, _b) - 1) as int)"
    same = lambda j, k: f"shiftright(_s[{j}], _b) = shiftright(_s[{k}], _b) and " + " and ".join(f"_words[{at(j)} + {d}] = _words[{at(k)} + {d}]" for d in range(3))
    t = t.withColumn("_r", F.expr(f"case when _again then transform(filter(sequence(0, size(_s) - 1), k -> (k > 0 and {same('k - 1', 'k')}) or (k + 1 < size(_s) and {same('k', 'k + 1')})), k -> {at('k')}) else cast(array() as array<int>) end"))
    t = t.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(_NOT_SPACE)))
    long = lambda c: c.cast("long")
    less = lambda a, rx: long(F.length(a) - F.length(F.regexp_replace(a, rx, "")))
    return t.select(
        *keep,
        long(F.col("_n")).alias("n_words"),
        long(F.length("_text") - F.length("_rest") + F.length("_dense")).alias("word_chars"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.size(F.array_distinct(F.flatten(F.transform("_r", lambda p: F.array(p, p + 1, p + 2)))))).alias("n_repeat_words"),
        less("_dense", f"{SYMBOLS}+").alias("n_symbols"),
        F.array(long(F.length("_text") - F.length("_rest")), *[less("_dense", f"{rx}+") for k, rx in CLASSES.items() if k != "lower"]).alias("classes"),
        F.transform(F.array(*map(F.lit, COMMON)), lambda w: long(F.size("_common") - F.size(F.array_remove(F.col("_common"), w)))).alias("common"),
    )


def judge(measures: DataFrame, lang: str) -> DataFrame:
    """measures with base_failed, char_distance, word_distance and kept."""

    def shares(counts: str, total: str) -> Column:
        """Shares of the counted classes and, last, of what is in none."""
        part = F.transform(counts, lambda x: x / F.greatest(F.col(total), F.lit(1)))
        return let(part, lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda s, x: s + x)))))

    m = measures.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = m.withColumn("_p", shares("classes", "word_chars")).withColumn("_q", shares("common", "n_words"))
    mean = lambda c, n: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)])
    reference = m.where((~F.col("base_failed")) & (F.col("n_words") >= MIN_WORDS)).groupBy(F.col(lang).alias("_lang")).agg(mean("_p", len(CLASSES) + 1).alias("_rp"), mean("_q", len(COMMON) + 1).alias("_rq"))
    m = m.join(reference, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    none = F.array(*[F.lit(0.0)] * len(COMMON), F.lit(1.0))
    m = m.withColumn("char_distance", _distance(F.col("_p"), F.col("_rp"))).withColumn("word_distance", _distance(F.col("_q"), F.col("_rq"))).withColumn("_far", _distance(none, F.col("_rq")))
    near = (F.col("n_words") < MIN_WORDS) | F.col("_rp").isNull() | ((F.col("char_distance") <= MAX_CHAR_DISTANCE) & (F.col("word_distance") <= MAX_WORD_SHARE * F.col("_far")))
    return m.withColumn("kept", ~F.col("base_failed") & near)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept).

    Null or empty text: no words, fails the base rules. A null language is a language of its own. Repeated rows each give a
    row; an empty table gives none. A language without a passing document has no reference: its documents go by base rules.
    """
    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("text"))
    m = cut(base_measures(spread(one), "text", ("doc_id", "_l")))
    return judge(m, "_l").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows that are rejected. Rows are told apart by id, text and language; equal rows share a verdict.

    A row with a null or empty text goes, as the base rules reject it; null ids and languages are values like others; columns
    come back as they are, whatever their names; an empty df stays empty.
    """
    key = {free_name(df, "key_id"): F.col(id_col).cast("long"), free_name(df, "key_text"): F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), free_name(df, "key_lang"): F.col(lang_col).cast("string")}
    k_id, k_text, k_lang = key
    m = cut(base_measures(df.select(*[c.alias(k) for k, c in key.items()], F.col(text_col).alias("text")), "text", tuple(key)))
    bad = judge(m, k_lang).where(~F.col("kept")).select(*[F.col(k).alias(f"bad_{k}") for k in key]).distinct().alias("b")
    marked = df.select("*", *[c.alias(k) for k, c in key.items()]).alias("m")
    on = F.col(f"m.{k_id}").eqNullSafe(F.col(f"b.bad_{k_id}")) & (F.col(f"m.{k_text}") == F.col(f"b.bad_{k_text}")) & F.col(f"m.{k_lang}").eqNullSafe(F.col(f"b.bad_{k_lang}"))
    return marked.join(bad, on, "left_anti").select(*columns_of(df))
