"""Personal data: pattern matches, and matches found after undoing disguises, mapped back to source offsets.

A transducer rewrites homoglyphs, spelled-out digits and at/dot disguises and records, for each rewritten piece, the source
span that it came from. Detectors run on the rewritten text; a match that touches a rewritten piece is mapped back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm.common import map_rows, spread

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where its run of digits does: what fails there fails from any later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HOMOGLYPHS = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict(zip("аеорсхуіѕјһԁԛԝкмтвн", "aeopcxyisjhdqwkmtbh")) | dict(zip("АВЕКМНОРСТХІЅЈ", "ABEKMHOPCTXISJ"))
_HOMOGLYPHS |= dict(zip("οανικ", "oavik")) | {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966) for d in range(10)} | {"․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "−": "-"}
_DIGIT = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_GAP = r"[\x20\t.,()-]{1,3}"
_DIGITS = f"(?:{_SPELLED}|[0-9]+)"
_PAIR = re.compile(rf"{_SPELLED}[\x20\t.,-]")
_RULES = re.compile(
    rf"(?P<digits>(?<![A-Za-z0-9])(?:plus{_GAP})?{_DIGITS}(?:{_GAP}{_DIGITS})+(?![A-Za-z]))"
    r"|(?P<at>\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?)"
    r"|(?P<dot>\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?)"
    r"|(?P<glyph>[" + "".join(map(re.escape, _HOMOGLYPHS)) + "])",
    re.IGNORECASE | re.ASCII,
)
_GLYPH = re.compile("[" + "".join(map(re.escape, _HOMOGLYPHS)) + "]")
_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]", re.IGNORECASE | re.ASCII)
_MIXED = re.compile(rf"[0-9]{_GAP}{_SPELLED}(?![a-z])|(?<![a-z]){_SPELLED}{_GAP}[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_JOINT = r"(?:\.|\x20dot\x20|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?)"
_ANCHOR = re.compile(r"\x20at\x20|@|\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?", re.IGNORECASE | re.ASCII)
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_JOINT}[A-Za-z0-9-]++)+", re.IGNORECASE | re.ASCII)
_PIECE = re.compile(rf"{_JOINT}([A-Za-z0-9-]++)", re.IGNORECASE | re.ASCII)
_TOP = re.compile("[A-Za-z]{2,}|(?i:xn--)[A-Za-z0-9-]+")
_DOT = re.compile(r"\x20dot\x20", re.IGNORECASE | re.ASCII)
#: First words of what is looked at in prose ("at the dot on the map"), unless one of the commonest endings follows.
_NO_HOST = frozenset("the a an this that these those each every my your his her its our their which what some any".split())
_COMMON = frozenset("com org net edu gov".split())
#: Words that stand before "at example.com" in prose, where it is a site and not the end of an address.
_NO_LOCAL = frozenset(
    "us me it them him you we they here there is are was were be been look looks site sites website page pages online available free more out up see "
    "visit details blog blogs docs documentation code source sources home live now shop store or and also only both not project repository version "
    "article articles post read find found download downloads based work works working worked hosted published posted looking browse start begin "
    "buy sold listed sign register join check learn information reviews company software team listing located directly today again example".split()
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain: led by each @, so that a long run without one costs nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def plain_addresses(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sign) of each spelled at and dot of addresses, in order: led by each at, whose sides are read up to the next."""
    out: list[tuple[int, int, str]] = []
    floor = 0
    for at in _ANCHOR.finditer(text):
        least, floor = floor, at.end()
        host = _HOST.match(text, at.end())
        if not host:
            continue
        top = None
        for piece in _PIECE.finditer(host[0]):
            top = piece if _TOP.fullmatch(piece[1]) else top
        if not top:
            continue
        name, last = host[0][: top.end()], top[1].lower()
        start, dots = at.start(), []
        while True:
            before = start
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start == before:
                break
            if start - 5 > least and _DOT.match(text, start - 5) and text[start - 6] in _LOCAL:
                dots.append((start - 5, start, "."))
                start -= 5
                continue
            break
        if text[start : at.start()].strip(".") == "":
            continue
        spelled = [(host.start() + d.start(), host.start() + d.end(), ".") for d in _DOT.finditer(name)]
        first = re.match("[A-Za-z0-9-]+", name)[0].lower()
        if at[0].lower() == " at ":
            if first in _NO_HOST and last not in _COMMON:
                continue
            if not spelled and not dots and text[start : at.start()].lower() in _NO_LOCAL:
                continue
            out += [*reversed(dots), (at.start(), at.end(), "@"), *spelled]
        else:
            out += [*reversed(dots), *spelled]
    return sorted(set(out))


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """(rewritten text, start of each rewritten piece there, its source span)."""
    parts: list[str] = []
    starts: list[int] = []
    sources: list[tuple[int, int]] = []
    done = size = 0

    def put(new: str, a: int, b: int) -> None:
        nonlocal done, size
        parts.append(text[done:a])
        size += a - done
        starts.append(size)
        sources.append((a, b))
        parts.append(new)
        size += len(new)
        done = b

    def spell(m: re.Match) -> None:
        """Spelled digits of a run. Seven or more of them alone are written together; else each is written where it stands."""
        tokens = list(_TOKEN.finditer(m[0]))
        words = [t[0].lower() for t in tokens if t[0].isalpha()]
        plus = words[:1] == ["plus"]
        if len(words) - plus >= 7 and not any(t[0].isdigit() for t in tokens):
            put("+" * plus + "".join(_DIGIT[w] for w in words[plus:]), m.start(), m.end())
        elif len(words) > plus:
            for k, t in enumerate(tokens):
                a, b, x = m.start() + t.start(), m.start() + t.end(), t[0]
                if a < done:
                    continue
                if plus and k == 0:
                    put("+", a, m.start() + tokens[1].end())
                elif x.isalpha():
                    put(_DIGIT[x.lower()], a, b)
                elif not x.isdigit() and x not in ("-", " ") and not set(x) - set(" \t,-"):
                    put(" ", a, b)

    plain = plain_addresses(text)[::-1]
    for m in _RULES.finditer(text):
        kind = m.lastgroup
        while plain and plain[-1][0] < m.start():
            a, b, new = plain.pop()
            if a >= done:
                put(new, a, b)
        if m.start() < done:
            continue
        if kind == "digits":
            spell(m)
        elif kind == "glyph":
            put(_HOMOGLYPHS.get(m[0], m[0]), m.start(), m.end())
        else:
            put("@" if kind == "at" else ".", m.start(), m.end())
    for a, b, new in reversed(plain):
        if a >= done:
            put(new, a, b)
    parts.append(text[done:])
    return "".join(parts), starts, sources


def _disguised(text: str) -> bool:
    if not text.isascii() and _GLYPH.search(text):
        return True
    low = text.lower()
    if " at " in low and ("." in low or " dot " in low) or "@" in low and " dot " in low:
        return True
    if _MIXED.search(low):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    return len(_PAIR.findall(low)) >= 6


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches that show only once disguises are undone, at their source offsets."""
    if not _disguised(text):
        return []
    new, starts, sources = normalise(text)
    if not starts:
        return []
    lengths = [0] * len(starts)
    for i, (s, (a, b)) in enumerate(zip(starts, sources)):
        after = starts[i + 1] - (sources[i + 1][0] - b) if i + 1 < len(starts) else len(new) - (len(text) - b)
        lengths[i] = after - s

    def back(at: int, end: bool) -> int:
        i = bisect_right(starts, at - end) - 1
        if i < 0:
            return at
        s, (a, b), n = starts[i], sources[i], lengths[i]
        if at - end < s + n:
            return b if end else a
        return b + at - (s + n)

    out = []
    for kind, s, e in base_spans(new):
        i = bisect_left(starts, s)
        inside = i < len(starts) and starts[i] < e
        if inside or (i and s < starts[i - 1] + lengths[i - 1]):
            out.append((kind, back(s, False), back(e, True)))
    return out


def find_pii(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by kind and start."""
    base = base_spans(text or "")
    return base, sorted({*base, *added_spans(text or "")})


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds and all spans.

    Null or empty text: no spans. Repeated rows each give a row; an empty table gives none.
    """

    def make():
        def f(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts):
                base, every = find_pii(t)
                n = [0, 0, 0, 0]
                for k, _, _ in base:
                    n[k] += 1
                yield (i, *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base))

        return f

    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(spread(one), ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long", make)
