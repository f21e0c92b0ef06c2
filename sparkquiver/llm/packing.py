"""Lexical retrieval packing.

A shard is a bounded run of documents within one task. Its BM25 inverted index over token ids returns, for the document that
opens a window, its nearest unused neighbours, which fill the window in order of score; the rarest terms are asked for first,
and further ones, down to the most common, only while the window has room; a document that doesn't fit is cut
and its rest opens the next window. The end of a task's last window is cut into powers of two, which take no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import map_rows, spread

WINDOW, END_ID = 4096, 2
#: A shard closes at so many tokens or documents. Words whose ids a task remembers.
SHARD_TOKENS, SHARD_DOCS, REMEMBERED = 4_000_000, 8192, 500_000
K1, B, QUERY_TERMS = 1.2, 0.75, 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Byte to character, as byte-level vocabularies write bytes.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_VISIBLE))}
_TO_SPACE = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
#: Characters that str.split takes for white space and the tokenizer may not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
#: Beyond plain and extended Latin letters, lower-casing and composing may depend on each other.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")
_STOPS = ".,;:!?"


class _Known(dict):
    """ids of words as bytes, worked out when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.encode, self.model = tokenizer.encode, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_STOPS)
        if core and core.isalpha() and core == core.lower() and (core.isascii() or not _BEYOND.search(core)):
            if core != word:  # stops after letters are a pre-token of their own
                ids = self[core] + self[word[len(core) :]]
            else:  # letters alone are one pre-token, which goes to the model as it is
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = _U32([t.id for t in self.model.tokenize(piece)])
        else:
            ids = _U32(self.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids


def _U32(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokens never hold white space, so a text's ids are those of its words in a row; words repeat, so their
    ids are remembered, a bounded number of them. The tokenizer lower-cases; a text of Latin letters is lower-cased first.
    """

    def __init__(self, path: str) -> None:
        self.known = _Known(_load(path))

    def encode(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not text.isascii() and _BEYOND.search(text) or _ODD_SPACE.search(text):
            words = [w for w in text.translate(_TO_SPACE).split(" ") if w]
        else:
            words = text.lower().split()
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = len(docs)
        pairs = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in pairs]
        size = np.array([len(t) for t in self.terms])
        term = np.concatenate(self.terms) if self.n else np.empty(0, np.uint32)
        tf = np.concatenate([c for _, c in pairs]).astype(np.float32) if self.n else np.empty(0, np.float32)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), size)
        length = np.array([len(d) for d in docs], dtype=np.float32)
        norm = K1 * (1 - B + B * length / max(float(length.mean()) if self.n else 1.0, 1.0))
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        term = term[order]
        self.vocabulary, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.df = df
        tf = tf[order]
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])

    def scores(self, d: int) -> Iterator[np.ndarray]:
        """BM25 scores of all documents against the rarest QUERY_TERMS terms of document d that another document holds too,
        then against twice as many each time, up to all of them. The end id is no term."""
        at = np.searchsorted(self.vocabulary, self.terms[d])
        at = at[(self.df[at] > 1) & (self.terms[d] != END_ID)]
        at = at[np.argsort(-self.idf[at], kind="stable")]
        score, done, most = np.zeros(self.n), 0, QUERY_TERMS
        while done < len(at):
            spans = [slice(self.first[i], self.last[i]) for i in at[done:most]]
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
            yield score
            done, most = most, 2 * most


def order_shard(docs: list[np.ndarray], fill: int, window: int = WINDOW) -> Iterator[int]:
    """Indexes of docs in packing order, given how full the open window is."""
    index, unused, at, left = Index(docs), np.ones(len(docs), dtype=bool), 0, len(docs)
    seed = None
    while left:
        cut = False
        for scores in index.scores(seed) if seed is not None else ():
            score = np.where(unused, scores, 0.0)
            for d in map(int, np.lexsort((np.arange(len(score)), -score))[: int((score > 0).sum())]):
                unused[d] = False
                left -= 1
                yield d
                fill += len(docs[d])
                if fill >= window:
                    fill, seed, cut = fill % window, d, True
                    break
            if cut or not left:
                break
        if not cut and left:
            while not unused[at]:
                at += 1
            seed = at
            unused[seed] = False
            left -= 1
            yield seed
            fill = (fill + len(docs[seed])) % window


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece; window is a power of two.

    Null or empty text is the end id alone. Repeated rows are packed each; a null id is kept. An empty table gives no sequence.
    Which documents share a window follows the splits of df, as shards lie within them: another number of cores or files may
    give other windows, never other ids. Other columns, whatever their names, don't matter.
    """
    path = path or tokenizer_path()

    def make():
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        ids: list = []
        docs: list[np.ndarray] = []
        total = sequence = fill = 0
        last: list[tuple] = []  # pieces of the open window: (doc_id, start, bytes, doc_tokens)
        end = np.array([END_ID], dtype="<u4").tobytes()

        def written(pieces: list[tuple], sizes: list[int]) -> Iterator[tuple]:
            """Rows of pieces dealt to sequences of the given sizes."""
            nonlocal sequence
            queue, k = list(pieces), 0
            for size in sizes:
                at = 0
                while at < size:
                    i, start, data, n = queue[k]
                    take = min(size - at, len(data) // 4)
                    yield i, start, take, zlib.crc32(data[: take * 4]), n, (part << 32) + sequence, at
                    at += take
                    if take * 4 == len(data):
                        k += 1
                    else:
                        queue[k] = (i, start + take, data[take * 4 :], n)
                sequence += 1

        def flush() -> Iterator[tuple]:
            nonlocal total, fill, last
            if not docs:
                return
            for d in order_shard(docs, fill, window):
                data, start, n = docs[d].tobytes(), 0, len(docs[d])
                while start < n:
                    take = min(window - fill, n - start)
                    last.append((ids[d], start, data[start * 4 : (start + take) * 4], n))
                    start += take
                    fill += take
                    if fill == window:
                        yield from written(last, [window])
                        last, fill = [], 0
            ids.clear()
            docs.clear()
            total = 0

        def f(more_ids: list, texts: list) -> Iterator[tuple]:
            nonlocal total
            for i, t in zip(more_ids, texts):
                tokens = np.frombuffer(encoder.encode(t or "") + end, dtype="<u4")
                ids.append(i)
                docs.append(tokens)
                total += len(tokens)
                if total >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                    yield from flush()

        def close() -> Iterator[tuple]:
            yield from flush()
            yield from written(last, [1 << b for b in reversed(range(window.bit_length())) if fill >> b & 1])

        f.close = close
        return f

    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(spread(one), ["doc_id", "text"], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)
