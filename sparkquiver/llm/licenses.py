"""License scan: an Aho-Corasick automaton over normalised words finds phrases and tags; a shunting-yard parser evaluates
the and/or/with expression that follows a tag against a policy. An expression's operands are known identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import map_rows, spread

#: Phrase to label; these are the contract's.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that the method adds, with the confidence of each.
NOTICES = {
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license v3": ("gpl-3", 0.9),
    "gnu general public license v2": ("gpl-2", 0.9),
    "gnu general public license": ("gpl", 0.7),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "bsd 3 clause license": ("bsd-3-clause", 0.9),
    "bsd 2 clause license": ("bsd-2-clause", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "creative commons attribution": ("cc-by", 0.6),
    "cc0 1 0 universal": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.5),
    "boost software license": ("bsl-1", 0.8),
    "isc license": ("isc", 0.7),
}
#: Public short identifiers of licences, and of exceptions that stand after `with`; an expression's operands are among them.
IDENTIFIERS = frozenset(
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause "
    "bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 "
    "cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-2.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0+ gpl-3.0-only gpl-3.0-or-later hpnd isc lgpl-2.0-only lgpl-2.0-or-later "
    "lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng mit mit-0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa "
    "odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sspl-1.0 tcl unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
)
EXCEPTIONS = frozenset("autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception openssl-exception qt-gpl-exception-1.0 wxwindows-exception-3.1".split())
#: Identifiers that satisfy a permissive-only policy.
PERMISSIVE = frozenset({"mit", "mit-0", "apache-2.0", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "cc0-1.0", "unlicense", "zlib", "0bsd", "ncsa", "postgresql", "upl-1.0", "x11"})
TAG = "spdx license identifier"
#: Confidence of a tag whose expression names no known licence.
BARE_TAG = 0.3
_JOIN = r"[^A-Za-z0-9\x80-\U0010ffff]+"
_TAG_TEXT = re.compile(rf"(?ai)(?<![A-Za-z0-9\x80-\U0010ffff])spdx{_JOIN}license{_JOIN}identifier(?![A-Za-z0-9\x80-\U0010ffff])[\x20\t]*:?")
_TOKEN = re.compile(r"[\x20\t]*+([A-Za-z0-9][A-Za-z0-9.+-]*|[()])")
#: Byte table: A-Z lower-cased; what can't be in a word becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def known(operand: str, exception: bool) -> bool:
    return operand in EXCEPTIONS if exception else operand in IDENTIFIERS or operand.startswith("licenseref-")


def to_postfix(text: str, at: int = 0, accept: Callable[[str, bool], bool] = lambda operand, exception: True) -> list[str]:
    """The licence expression at a place of text in postfix, by the shunting yard: operands in lower case, operators in upper case.

    accept tells operands from other words, and exceptions, which stand after `with`, from licences. Reading stops at the first token
    that can't continue the expression, as at a line's end; an operator without its right operand, and a parenthesis without its
    partner, are left out.
    """
    output: list[str] = []
    stack: list[str] = []
    operand_next, depth = True, 0
    while m := _TOKEN.match(text, at):
        token, low, at = m[1], m[1].lower(), m.end()
        if operand_next:
            if token == "(":
                stack.append("(")
                depth += 1
                continue
            low = low if low in IDENTIFIERS else low.rstrip(".-")
            if low in _PRECEDENCE or not accept(low, stack[-1:] == ["with"]):
                break
            output.append(low)
            operand_next = False
        elif low in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                output.append(stack.pop().upper())
            stack.append(low)
            operand_next = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                output.append(stack.pop().upper())
            stack.pop()
            depth -= 1
        else:
            break
    while operand_next and stack and output:  # what was opened or joined last lacks its right operand
        if stack.pop() != "(":
            operand_next = False
    output += [x.upper() for x in reversed(stack) if x != "("]
    return output


def evaluate(text: str, allowed: frozenset[str] = PERMISSIVE, at: int = 0) -> tuple[list[str], bool]:
    """(labels, whether licences in allowed satisfy the expression): `and` needs both sides, `or` either, `with` its licence.
    Operands are known identifiers."""
    values: list[tuple[frozenset[str], bool]] = []
    for x in to_postfix(text, at, known):
        if x in ("AND", "OR", "WITH"):
            (right, ok_right), (left, ok_left) = values.pop(), values.pop()
            if x == "WITH":
                values.append((frozenset(f"{p} with {q}" for p in left for q in right), ok_left))
            else:
                values.append((left | right, ok_left and ok_right if x == "AND" else ok_left or ok_right))
        else:
            values.append((frozenset({x}), x in allowed))
    labels, ok = values[-1] if values else (frozenset(), False)
    return sorted(labels), ok


def build_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, (label, weight) in NOTICES.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, weight, False))
    for phrase, label in BASE.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, 0.9, True))
    a.add_word(f" {TAG} ", (3, "", 1.0, False))
    a.make_automaton()
    return a


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def scan_text(text: str, automaton: ahocorasick.Automaton, allowed: frozenset[str] = PERMISSIVE) -> tuple:
    words = normal_words(text)
    n = len(words)
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    first = last = None
    n_base, base, extra, score, tagged = 0, set(), set(), 0.0, False
    spaces = seen = 0
    for end, (size, label, weight, is_base) in automaton.iter(joined):
        if is_base:
            spaces += joined.count(" ", seen, end)
            seen = end
            at = spaces - size
            n_base += 1
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            base.add(label)
        elif label:
            extra.add(label)
        else:
            tagged = True
            continue
        score = max(score, weight)
    verdicts: list[bool] = []
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            labels, ok = evaluate(text, allowed, m.end())
            extra.update(labels)
            verdicts += [ok] if labels else []
        score = max(score, 1.0 if verdicts else BARE_TAG)
    permitted = all(verdicts) if verdicts else None
    return n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | extra)), score, len(verdicts), permitted


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row a document: words, places of the base phrases, labels, a confidence from 0 to 1, and the verdict of its tags.

    n_expressions counts the tags that a licence expression follows; permitted tells whether licences in `allowed` satisfy all of
    them, null where there is none. Null or empty text: no words, null places and verdict, empty labels, score 0. Repeated
    rows each give a row; a null id is kept; an empty df gives no row; other columns, whatever their names, don't matter.
    """

    def make():
        automaton = build_automaton()

        def f(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts):
                yield (i, *scan_text(t or "", automaton, allowed))

        return f

    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, permitted boolean"
    return map_rows(spread(one), ["doc_id", "text"], ddl, make)
