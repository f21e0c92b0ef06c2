"""Chat formatting by schema fingerprint.

A record's nested field paths, sorted and hashed, are its fingerprint; the fingerprint selects a declarative mapping
that turns the record's layout into canonical (role, text) turns. Rows of a turn table are records too, and rows of other layouts
may stand among them; what is null in a row isn't in its fingerprint. Formatting marks turns with control strings, which are
escaped inside texts, reversibly, so that no text can forge a turn; the loss mask covers assistant texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquiver.llm.common import map_rows

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: `<` before |, /, s or another <, and `[` before INST] or /INST], begin every control string known here.
_ESCAPE = re.compile(r"\\|<(?=[|/sS<])|\[(?=/?INST\])", re.IGNORECASE)
_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_UNESCAPE = re.compile(r"\\([\\lb])")
_IN = {"\\": "\\", "l": "<", "b": "["}
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _IN[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text there)."""
    head = f"{TURN}{escape(role)}{BODY}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(formatted)]


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the non-null leaves; [] stands for any element of a list."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(field_paths(v, f"{at}[]") for v in value))
    return set() if value is None else {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _with(required: str, optional: str = "") -> list[set[str]]:
    """The required fields with each choice of the optional ones."""
    extra = optional.split()
    return [{*required.split(), *some} for k in range(len(extra) + 1) for some in combinations(extra, k)]


#: Each mapping: where turns lie, or which fields make which turns, in order. A list of fields is joined by blank lines. `one` is a
#: record that is a turn itself. Roles are kept as they are unless the mapping renames them.
_LAYOUTS: list[tuple[dict, list[set[str]]]] = [
    ({"one": True, "role": "role", "text": "text"}, _with("text", "role turn")),
    ({"one": True, "role": "role", "text": "content"}, _with("content", "role turn")),
    ({"one": True, "role": "from", "text": "value", "roles": _ROLES}, _with("value", "from turn")),
    ({"each": "messages", "role": "role", "text": "content"}, _with("messages[].content messages[].role", "turn")),
    ({"each": "messages", "role": "role", "text": "text", "order": "turn"}, _with("messages[].role messages[].text", "messages[].turn turn")),
    ({"each": "conversations", "role": "from", "text": "value", "roles": _ROLES}, _with("conversations[].from conversations[].value", "turn")),
    ({"system": "system", "user": ["instruction", "input"], "assistant": ["output"]}, _with("instruction output", "system input turn")),
    ({"user": ["prompt"], "assistant": ["completion"]}, _with("prompt completion", "turn")),
    ({"user": ["prompt"], "assistant": ["response"]}, _with("prompt response", "turn")),
    ({"system": "system_prompt", "user": ["question"], "assistant": ["answer"]}, _with("question answer", "system_prompt turn")),
]
MAPPINGS = {fingerprint(paths): spec for spec, shapes in _LAYOUTS for paths in shapes}
#: Rows of a turn table are turns even where their text is null.
ROW_MAPPINGS = MAPPINGS | {fingerprint(paths): _LAYOUTS[0][0] for paths in _with("", "role turn")}


def canonical(record: dict, mappings: dict[str, dict] = MAPPINGS) -> tuple[str, list[tuple[str, str]]]:
    """(fingerprint, turns); no turns where no mapping is known for the fingerprint."""
    key = fingerprint(field_paths(record))
    spec = mappings.get(key)
    return key, [] if spec is None else turns_of(record, spec)


def turns_of(record: dict, spec: dict) -> list[tuple[str, str]]:
    """The (role, text) turns of a record by a mapping."""
    if "one" in spec or "each" in spec:
        items = [record] if "one" in spec else list(record[spec["each"]])
        if "order" in spec:
            items.sort(key=lambda m: m.get(spec["order"]) or 0)
        roles = spec.get("roles", {})
        return [(roles.get(r, r), str(t)) for m in items for r, t in [(str(m.get(spec["role"]) or ""), m.get(spec["text"]) or "")]]
    turns = []
    for role, fields in spec.items():
        parts = [str(record[f]) for f in ([fields] if isinstance(fields, str) else fields) if record.get(f)]
        if parts or role != "system":
            turns.append((role, "\n\n".join(parts)))
    return turns


def format_records(df: DataFrame, json_col: str = "record", id_col: str = "id") -> DataFrame:
    """(id, fingerprint, formatted, loss_spans, n_turns) of JSON records of mixed layouts.

    Null, malformed or unknown records give an empty text and no turns; the fingerprint tells which mapping is missing.
    """

    def make():
        def f(ids: list, records: list) -> Iterator[tuple]:
            for i, text in zip(ids, records):
                try:
                    record = json.loads(text or "{}")
                except ValueError:
                    record = {}
                key, turns = canonical(record if isinstance(record, dict) else {})
                out, spans, size = [], [], 0
                for role, body in turns:
                    piece, a, b = render(role, body)
                    if role == "assistant":
                        spans.append([size + a, size + b])
                    size += len(piece)
                    out.append(piece)
                yield i, key, "".join(out), spans, len(turns)

        return f

    one = df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("record"))
    return map_rows(one, ["id", "record"], "id string, fingerprint string, formatted string, loss_spans array<array<long>>, n_turns long", make)


def format_rows(df: DataFrame, fields: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """(conv_id, position, formatted, loss_start, loss_end): one formatted piece a turn, conversations in order of turn.

    df: (conv_id, turn, ...). A row's record is what is in its columns `fields` and not null; its fingerprint selects the mapping
    that gives its turns, one or several. Concatenating a conversation's pieces by position gives the whole. Null roles and
    texts are empty; a null turn comes first; ties go by the other fields; repeated rows stay; rows with a null conv_id are one
    conversation; a row that no mapping fits gives no turn; an empty df gives no piece. Other columns, whatever their names, don't
    matter. A conversation is a sorted run that a task streams, so that its length doesn't matter.
    """
    names = list(fields)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.col(c).cast("long").alias(c) if c == "turn" else F.col(c) for c in names])
    order = [F.coalesce(F.col(c), F.lit("")) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in names]
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    nested = {c for c in names if not isinstance(df.schema[c].dataType, T.AtomicType)}

    def make():
        now, position = object(), 0
        known: dict[tuple, dict | None] = {}  # mapping by which plain fields are there

        def f(ids: list, *columns: list) -> Iterator[tuple]:
            nonlocal now, position
            for i, *values in zip(ids, *columns):
                if i != now:
                    now, position = i, 0
                record = {c: v for c, v in zip(names, values) if v is not None}
                flat = not nested & record.keys()
                shape = tuple(record) if flat else None
                if shape is None or shape not in known:
                    spec = ROW_MAPPINGS.get(fingerprint(field_paths(record)))
                    if flat:
                        known[shape] = spec
                else:
                    spec = known[shape]
                for who, body in turns_of(record, spec) if spec else ():
                    piece, a, b = render(who, body)
                    yield (i, position, piece, *((a, b) if who == "assistant" else (None, None)))
                    position += 1

        return f

    return map_rows(rows, ["conv_id", *names], "conv_id long, position long, formatted string, loss_start long, loss_end long", make)


def read_back(pieces: DataFrame) -> DataFrame:
    """A digest of each conversation from its formatted pieces alone, which keep the order and place that format_rows gave.

    Roles and texts come from parsing the formatted text; what is under the loss mask is unescaped and digested in order. A null
    conv_id is a conversation of its own; no pieces give no row.
    """
    schema_ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, last boolean"

    def run(batches):
        import pandas as pd

        names = [x.strip().split(" ")[0] for x in schema_.split(",")]
        now, open_ = None, False
        turns = loss = None
        n = chars = size = 0

        def close() -> tuple:
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size, True)

        for pdf in batches:
            out = []
            for i, position, text, a, b in zip(*(pdf[c] for c in ("conv_id", "position", "formatted", "loss_start", "loss_end"))):
                if position == 0:
                    if open_:
                        out.append(close())
                    now, open_ = None if pd.isna(i) else int(i), True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = size = 0
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                size += len(text)
                if not pd.isna(a):
                    masked = unescape(text[int(a) : int(b)])
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    chars += len(masked)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if open_:
            yield pd.DataFrame([close()], columns=names).astype({"conv_id": "Int64"})

    return pieces.mapInPandas(run, schema_).drop("last")
