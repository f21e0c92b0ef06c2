"""Schemas of the graph's tables."""

from __future__ import annotations

NODE = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "start_column int, end_column int, signature string, docstring string, visibility string, is_exported boolean, is_async boolean, "
    "is_static boolean, is_abstract boolean, extra map<string,string>, seq bigint"
)
EDGE = "id string, source string, target string, kind string, line int, col int, metadata string, provenance string, seq bigint"
FILE = "path string, language string, mtime bigint, content_hash string, indexed_at bigint"
COVERAGE = "path string, language string, status string, reason string, size_bytes bigint, indexed_at bigint"
EMBEDDING = "id string, vec array<double>"
#: The search index: a term of a node, how often the node has it, and how many terms the node has.
POSTING = "term string, id string, tf int, length int"

#: Kinds that a definition search leaves out.
NOT_DEFINITIONS = ("file", "import", "export")
#: Kinds that seed a blast radius.
SEED_KINDS = ("function", "method", "class", "struct", "trait", "interface", "route", "constructor")
#: Kinds that can enclose a line.
SPAN_KINDS = ("function", "method", "class", "trait", "interface", "struct", "route")
CALLABLE_KINDS = ("function", "method", "class", "struct", "trait")


class GraphError(Exception):
    """Base of the errors of this library."""


class ParseError(GraphError):
    """A query or a request that can't be read."""


class NotFound(GraphError):
    """A node or name that isn't in the graph."""


class InvalidRequest(GraphError):
    """A request with an argument out of range."""


class StorageError(GraphError):
    """A store that can't be read or written."""


def columns(ddl: str) -> list[str]:
    depth, out, part = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.split()[0] for x in [*out, part]]
