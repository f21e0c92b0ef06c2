"""Secret scan: pattern matches plus dictionary-primed compression novelty.

A candidate token in a sensitive context is compressed by zstandard with a raw-content dictionary made of common
identifiers and the text around the candidate. Its marginal compressed bytes say how much of it neither the
identifiers nor its surroundings explain; a candidate that stays nearly incompressible, against what its own characters
would take at best, is reported as kind "novel" unless it is spelled like names. Short names that the dictionary lacks don't
compress either, so a candidate's bits under letter triples of a public vocabulary are held against those of random choice
from its own alphabet.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import map_rows, replace_texts, spread
from sparkquiver.llm.packing import tokenizer_path

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CUE_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "api", "access", "private", "credential", "bearer", "authoriz", "auth_", "auth-", "signature", "client_", "ssh-", "key")
_CUE = re.compile(r"(?ai)pass(?:word|wd|phrase)|\bpwd\b|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|secret[ _-]?key|credential|bearer|authorization|\bauth[_-]|signature|client[_-](?:id|secret)|ssh-(?:rsa|ed25519)")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9+/_][A-Za-z0-9+/_=.~-]{11,}")
#: A candidate starts within so many code points after the end of a cue, and has so many characters at least.
REACH, SHORTEST = 48, 12
#: Code points on either side that prime the dictionary.
AROUND = 256
MIN_MARGINAL, MIN_RATIO = 10, 0.75
#: Characters from which zstandard codes literals by their frequencies.
CODED = 64
#: Share of the bits of random choice from its alphabet that a candidate takes as a name at least. Bits to stay in a class of
#: characters, to end a capital initial, and to change otherwise.
MIN_SPELLING, STAY, INITIAL, CHANGE = 0.9, 0.3, 0.5, 2.5
IDENTIFIERS = (
    "username user_name password passwd passphrase secret_key secret token access_token refresh_token id_token api_key apikey "
    "access_key_id secret_access_key private_key public_key client_id client_secret credentials authorization bearer basic "
    "signature certificate session_id cookie config configuration settings environment variable value default example "
    "localhost database connection string server hostname address port http https www com org net io index main function "
    "return import export class public private protected static final const string integer boolean true false null none "
    "undefined undefined changeme placeholder your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 version revision request response header "
    "content-type application/json text/plain utf-8 timestamp expires issued audience subject scope read write admin"
).encode()


def marginal_bytes(candidate: str, around: str, identifiers: bytes = IDENTIFIERS) -> int:
    """Compressed bytes that candidate adds once the dictionary holds the identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(identifiers + b"\n" + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(c.compress(candidate.encode("utf-8", "replace"))) - len(c.compress(b""))


def literal_bound(word: str) -> float:
    """Bytes that the characters of word take at best, if nothing of it is found anywhere."""
    n = len(word)
    return n if n < CODED else min(n, -sum(c * math.log2(c / n) for c in Counter(word).values()) / 8)


@lru_cache(maxsize=1)
def _letter_bits() -> dict[str, float]:
    """Bits of a letter after two others (^ where a word begins) in the vocabulary's whole words, smoothed by shorter contexts."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (k[:-4] for k in vocabulary if k.endswith("</w>") and len(k) >= 7)
    three = Counter(w[i : i + 3] for w in ("^^" + w for w in words if w.isascii() and w.isalpha() and w.islower()) for i in range(len(w) - 2))
    after, two, before, one = Counter(), Counter(), Counter(), Counter()
    for k, n in three.items():
        after[k[:2]] += n
        two[k[1:]] += n
        before[k[1]] += n
        one[k[2]] += n
    total, letters, bits = sum(one.values()), "abcdefghijklmnopqrstuvwxyz", {}
    for c in letters:
        p1 = (one[c] + 1) / (total + 26)
        for b in "^" + letters:
            p2 = (two[b + c] + 5 * p1) / (before[b] + 5)
            for a in "^" + letters:
                bits[a + b + c] = -math.log2((three[a + b + c] + 5 * p2) / (after[a + b] + 5))
    return bits


def alphabet_bits(word: str) -> float:
    """Bits of word as random choices from the smallest usual alphabet that holds it."""
    has = [bool(re.search(p, word)) for p in ("[a-z]", "[A-Z]", "[0-9]")]
    if re.fullmatch("[0-9A-F]+|[0-9a-f]+", word):
        n = 16 if has[0] or has[1] else 10
    elif re.fullmatch("[A-Z2-7]+", word):
        n = 32 if has[2] else 26
    else:
        n = 26 * has[0] + 26 * has[1] + 10 * has[2] + len(set(re.sub("[A-Za-z0-9]", "", word)))
    return len(word) * math.log2(max(n, 2))


def spelling_bits(word: str) -> float:
    """Bits of word as a name: letters by the two before them in their part of it, digits at random, and changes of class."""
    letter, bits, context, last, before = _letter_bits(), 0.0, "^^", None, None
    for c in word:
        kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
        if kind > 1:
            bits += math.log2(10) if kind == 2 else 1
            context = "^^"
        else:
            if kind == 1 and last == 0:
                context = "^^"
            bits += letter[context + c.lower()]
            context = context[1] + c.lower()
        if last is not None:
            bits += STAY if kind == last else INITIAL if (last, kind) == (1, 0) and before != 1 else CHANGE
        before, last = last, kind
    return bits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches; kind is an index into KINDS."""
    out = []
    low = text.lower()
    if any(k in low for k in _ASSIGN_KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, taken: list[tuple[int, int, int]], identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Incompressible candidates near a cue that no span of taken overlaps."""
    low = text.lower()
    if not any(w in low for w in _CUE_WORDS):
        return []
    out, done = [], 0
    for cue in _CUE.finditer(text):
        start = max(cue.end(), done)
        # The limit holds for a candidate's start only: its first SHORTEST characters find it, and it is read to its end.
        while (m := _CANDIDATE.search(text, start, cue.end() + REACH + SHORTEST)) and (m := _CANDIDATE.match(text, m.start())):
            start = done = m.end()
            word = m[0].strip(".-=~") or m[0]
            a = m.start() + m[0].find(word)
            b = a + len(word)
            if len(word) < SHORTEST:
                continue
            if any(s < b and a < e for s, _, e in taken):
                continue
            bytes_ = marginal_bytes(word, text[max(0, a - AROUND) : a] + text[b : b + AROUND], identifiers)
            if bytes_ >= MIN_MARGINAL and bytes_ >= MIN_RATIO * literal_bound(word) and spelling_bits(word) >= MIN_SPELLING * alphabet_bits(word):
                out.append((a, 3, b))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base))


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """text with each secret replaced by mask; overlapping spans are merged. None stays None."""
    if text is None:
        return None
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of each kind and all spans.

    Null or empty text: no spans. Repeated rows each give a row; an empty table gives none. A null id is kept.
    """

    def make():
        def f(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts):
                base = base_spans(t or "")
                extra = novel_spans(t or "", base)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                digest = hashlib.sha256(_join(base).encode()).hexdigest()
                yield (i, *n, len(extra), digest, _join(sorted(base + extra)))

        return f

    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(spread(one), ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string", make)


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """df with its secrets masked and its length column, if it has one, set to the new length of a changed text. All rows stay.

    A null text stays null; other columns stay as they are, whatever their names; an empty df stays empty.
    """
    return replace_texts(df, text_col, length_col, redact)
