"""A JSON-RPC server over standard input and output with the engine's tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame

from sparkquiver.engine import GraphEngine
from sparkquiver.graph import Graph
from sparkquiver.operators.architecture import parse_aspects
from sparkquiver.operators.traverse import DIRECTIONS
from sparkquiver.schema import GraphError, InvalidRequest
from sparkquiver.sources.store import projects

PROTOCOL = "2024-11-05"
#: Rows that a tool's answer holds at most; row sets of any size come from the engine's DataFrames.
MAX_ROWS = 1000


def rows(df: DataFrame, limit: int = MAX_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def _graph(g: Graph) -> dict:
    return {"nodes": rows(g.nodes.drop("extra")), "edges": rows(g.edges)}


def _direction(a: dict) -> str:
    d = a.get("direction", "inbound")
    if d not in DIRECTIONS:
        raise InvalidRequest(f"direction must be one of {', '.join(DIRECTIONS)}")
    return d


def tools(e: GraphEngine) -> dict[str, tuple[str, dict[str, str], list[str], Callable[[dict], object]]]:
    """name: (description, properties, required, call)."""

    def complexity(a):
        first = e.find_definitions(a["name"]).first()
        return rows(e.complexity(first["id"])) if first else []

    def coverage(a):
        counts, entries = e.index_coverage(a.get("path_prefix"))
        return {"counts": rows(counts), "entries": rows(entries)}

    def dead(_):
        report, entries = e.dead_code()
        return {"report": rows(report), "entries": rows(entries)}

    def blast(a):
        seeds, hit, files = e.blast_radius(a["changed_paths"], a.get("depth", 3), _direction(a))
        return {"seeds": rows(seeds), "impact": rows(hit.select("id", "name", "kind", "file_path")), "files": rows(files)}

    def cypher(a):
        df, cut_short = e.cypher(a["query"])
        return {"columns": df.columns, "rows": [list(r) for r in df.limit(MAX_ROWS).collect()], "truncated": cut_short}

    s, n = "string", "integer"
    return {
        "index_repository": ("Build or update the index of a tree", {"path": s, "incremental": "boolean"}, ["path"], lambda a: e.update(a["path"]) if a.get("incremental") else e.build(a["path"])),
        "check_index_coverage": ("Which files are indexed and why others aren't", {"path_prefix": s}, [], coverage),
        "index_status": ("Counts of the graph", {}, [], lambda a: rows(e.stats())),
        "list_projects": ("Stores in a folder", {"folder": s}, ["folder"], lambda a: rows(projects(e.spark, a["folder"]))),
        "search_graph": ("Ranked search of identifiers", {"query": s, "limit": n}, ["query"], lambda a: rows(e.search(a["query"], a.get("limit", 50)).drop("extra"))),
        "find_definitions": ("Definitions of a name", {"name": s}, ["name"], lambda a: rows(e.find_definitions(a["name"]).drop("extra"))),
        "get_subgraph": ("Neighbourhood of a node", {"node_id": s, "depth": n}, ["node_id"], lambda a: _graph(e.subgraph(a["node_id"], a.get("depth", 2)))),
        "search_code": ("Lines with all words of a pattern, by enclosing node", {"pattern": s, "root": s, "limit": n, "context": n}, ["pattern"], lambda a: rows(e.search_code(a["pattern"], a.get("root"), limit=a.get("limit", 10), context=a.get("context", 3)))),
        "complexity": ("Complexity of a definition", {"name": s}, ["name"], complexity),
        "dead_code": ("Definitions that nothing calls", {}, [], dead),
        "blast_radius": ("What changed files can affect", {"changed_paths": "array", "depth": n, "direction": s}, ["changed_paths"], blast),
        "get_architecture": ("Architecture report", {"aspects": s, "scope": s, "top_n": n}, [], lambda a: {k: rows(v) for k, v in e.architecture_overview(parse_aspects(a.get("aspects", "")), a.get("scope"), a.get("top_n", 20)).items()}),
        "query_graph": ("A Cypher query", {"query": s}, ["query"], cypher),
        "trace_path": ("Callers or callees of a name", {"name": s, "direction": s, "depth": n}, ["name"], lambda a: rows(e.trace_path(a["name"], _direction(a), a.get("depth", 3)))),
    }


def handle(message: dict, known: dict) -> dict | None:
    """The answer to a message, or None to a notification."""
    method, answer = message.get("method"), {"jsonrpc": "2.0", "id": message.get("id")}
    if "id" not in message:
        return None
    if method == "initialize":
        return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkquiver", "version": "0.1.0"}}}
    if method == "tools/list":
        return answer | {"result": {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": {p: {"type": t} for p, t in props.items()}, "required": need}} for k, (d, props, need, _) in known.items()]}}
    if method != "tools/call":
        return answer | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    params = message.get("params") or {}
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in known:
        return answer | {"error": {"code": -32601, "message": f"unknown tool {name}"}}
    try:
        missing = [k for k in known[name][2] if k not in args]
        if missing:
            raise InvalidRequest(f"missing argument {missing[0]}")
        text, failed = json.dumps(known[name][3](args), default=str), False
    except (GraphError, OSError) as e:
        text, failed = f"{type(e).__name__}: {e}", True
    return answer | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(engine: GraphEngine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    known = tools(engine)
    for line in source:
        if not line.strip():
            continue
        try:
            out = handle(json.loads(line), known)
        except ValueError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if out is not None:
            print(json.dumps(out), file=sink, flush=True)
