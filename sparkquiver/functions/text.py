"""Identifier tokens and search text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def identifier_tokens(c: Column) -> Column:
    """Words of an identifier, in lower case; a word equal to the one before it goes. Acronyms stay joined."""
    spaced = F.regexp_replace(F.ltrim(c, F.lit("_")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.filter(F.split(ascii_lower(F.translate(spaced, "_", " ")), " +"), lambda w: w != "")
    return let(words, lambda a: F.filter(a, lambda w, i: (i == 0) | (F.get(a, i - 1) != w)))


def tokenize_identifier(c: Column) -> Column:
    return F.array_join(identifier_tokens(c), " ")


def tokenize_for_search(*parts: Column) -> Column:
    """Tokens of each part, without empty parts, joined by spaces; null counts as empty."""
    return F.array_join(F.filter(F.array(*[tokenize_identifier(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), " ")


def search_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits, diacritics removed (canonical marks over Latin letters)."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.filter(F.split(F.regexp_replace(F.translate(F.lower(c), marked, plain), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def sanitize_id_segment(c: Column) -> Column:
    return F.translate(c, "/:{}<>*? ", "_________")


def signature_of_line(line: Column) -> Column:
    """The first 120 characters of a trimmed line; null where nothing is left."""
    return F.nullif(F.left(F.trim(line), F.lit(120)), F.lit(""))


def is_test_name(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("test_") | low.startswith("it_") | low.endswith("_test") | low.contains("::test_")
