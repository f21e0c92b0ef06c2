"""Language-model scores by a subword lattice.

The pieces are those of an existing public vocabulary; their log probabilities are counted here, from that vocabulary's
segmentations of the training words. A word's probability sums over all its segmentations, by a forward recursion in log space;
no piece holds a word's beginning but as its first character, so a text's marginal is the product of its words' and the end's.

Counts follow the data: a task counts its words, the words' counts are summed by word, and each group of documents is sent the
counts and lattice scores of just the words that it holds. Rows are dealt to groups whatever their ids, and there are as many
groups as keep their texts near GROUP_BYTES, so that neither a repeated id nor a null one makes a group that outgrows a task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import arrow_schema, map_rows, spread
from sparkquiver.operators.components import cut

#: Bytes of text a group; a group's words are one task's dictionary.
GROUP_BYTES = 8_000_000
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
SMOOTH = 0.1
MARK = "▁"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@lru_cache(maxsize=2)
def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Forward recursion over all segmentations of a word into pieces of a vocabulary with given probabilities."""

    def __init__(self, path: str, counts: dict[int, int], ends: int) -> None:
        sp = _load(path)
        size = sp.vocab_size()
        total = sum(counts.values()) + ends + SMOOTH * (size + 1)
        self.end = math.log((ends + SMOOTH) / total)
        self.piece: dict[str, float] = {}
        self.byte = [0.0] * 256
        for i in range(size):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            p = math.log((counts.get(i, 0) + SMOOTH) / total)
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = p
            elif MARK not in sp.id_to_piece(i)[1:]:
                self.piece[sp.id_to_piece(i)] = p
        self.longest = max(map(len, self.piece), default=1)

    def word(self, word: str) -> float:
        """log of the sum of the probabilities of all segmentations; a character outside the vocabulary is its UTF-8 bytes."""
        s = MARK + word
        n, piece, longest = len(s), self.piece, self.longest
        # Scaled sums: sums[i] * exp(base[i]) is the probability of the first i characters.
        log = [0.0] * (n + 1)
        for end in range(1, n + 1):
            terms = []
            for start in range(max(0, end - longest), end):
                p = piece.get(s[start:end])
                if p is not None:
                    terms.append(log[start] + p)
            if s[end - 1] not in piece:
                terms.append(log[end - 1] + sum(self.byte[b] for b in s[end - 1].encode("utf-8", "surrogatepass")))
            if len(terms) == 1:
                log[end] = terms[0]
            else:
                top = max(terms)
                log[end] = top + math.log(sum([math.exp(t - top) for t in terms]))
        return log[n]

    def text(self, words: list[str]) -> float:
        return sum(map(self.word, words)) + self.end


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every word of docs (doc_id, text) and how often training texts hold it."""

    def make():
        counts: Counter = Counter()

        def out() -> Iterator[tuple]:
            yield from ((w.decode("utf-8", "surrogatepass"), c) for w, c in counts.items())
            counts.clear()

        def f(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts):
                words = words_of(t)
                if held_out(i):
                    for w in words:
                        counts[w] += 0
                else:
                    counts.update(words)
                if len(counts) > HELD:
                    yield from out()

        f.close = out
        return f

    return map_rows(spread(docs), ["doc_id", "text"], "word string, c long", make).groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(words: DataFrame, path: str) -> dict[int, int]:
    """How often each piece stands in the vocabulary's own segmentation of the training words; as many numbers as pieces."""

    def make():
        sp = _load(path)
        counts: Counter = Counter()

        def f(word: list, c: list) -> Iterator[tuple]:
            for pieces, n in zip(sp.encode(word, num_threads=1) if word else [], c):
                for p in pieces:
                    counts[p] += n
            return iter(())

        f.close = lambda: iter(counts.items())
        return f

    rows = map_rows(words.where("c > 0"), ["word", "c"], "piece int, n long", make).groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of df.

    Null, empty or blank text is its end alone. Repeated rows count and are scored each. A null id counts as the text "". An empty
    df gives no row; its other columns, whatever their names, don't matter.
    Scores are log10 probabilities; without training texts every word is unknown and scores come from smoothing alone.
    """
    path = path or vocabulary_path()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)), F.count_if(~held)).first()
    words = cut(count_words(docs))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = total + ends, kinds + (ends > 0)
    lattice = docs.sparkSession.sparkContext.broadcast(Lattice(path, count_pieces(words, path), ends))

    def scored():
        model = lattice.value

        def f(word: list, c: list) -> Iterator[tuple]:
            return ((w, n, model.word(w)) for w, n in zip(word, c))

        return f

    table = map_rows(words, ["word", "c"], "word string, c long, p double", scored)
    groups = max(1, -(-size // GROUP_BYTES))
    parts = max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A row's place in the scan deals it; both uses of the groups read one shuffle.
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"), "doc_id", "text").repartition(parts, "g")

    def asked():
        want: dict[int, set] = {}

        def f(g: list, _ids: list, texts: list) -> Iterator[tuple]:
            for k, t in zip(g, texts):
                want.setdefault(k, set()).update(words_of(t))
            return iter(())

        f.close = lambda: ((k, w.decode("utf-8", "surrogatepass")) for k, s in want.items() for w in s)
        return f

    told = map_rows(dealt, ["g", "doc_id", "text"], "g int, word string", asked).join(table, "word").select("g", "word", "c", "p")
    below = total + SMOOTH * (kinds + 1)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = right.column("c").to_numpy()
        at = dict(zip(right.column("word").cast(pa.binary()).to_pylist(), range(len(c))))
        base = np.log10((c + SMOOTH) / below)
        model = right.column("p").to_numpy() / math.log(10)
        end_base, end_model = math.log10((ends + SMOOTH) / below), lattice.value.end / math.log(10)
        out = []
        for chunk in left.select(["doc_id", "text"]).to_batches(max_chunksize=256):
            for i, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                words = words_of(t)
                k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                out.append((i, held_out(i), len(words) + 1, int((c[k] > 0).sum()) + (ends > 0), total, float(base[k].sum()) + end_base, float(model[k].sum()) + end_model))
        columns = zip(*out) if out else [()] * len(schema)
        return pa.table([pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)

    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(run, ddl)
