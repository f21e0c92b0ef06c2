"""Command line: python -m sparkquiver.cli --db STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from sparkquiver import rpc
from sparkquiver.engine import GraphEngine
from sparkquiver.operators.architecture import parse_aspects
from sparkquiver.operators.traverse import DIRECTIONS
from sparkquiver.schema import GraphError
from sparkquiver.sources.store import export_json, projects


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkquiver")
    p.add_argument("--db", default=".sparkquiver")
    p.add_argument("--root", default=".")
    p.add_argument("--unique-ids", action="store_true", help="put the path into node ids")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c.add_argument(*a, **k) for c in [sub.add_parser(name)] for a, k in args]
    arg = lambda *a, **k: (a, k)
    whole = lambda flag, n: arg(flag, type=int, default=n)
    add("build", arg("--incremental", action="store_true"))
    add("coverage", arg("--prefix"))
    add("stats")
    add("search", arg("query"), whole("--limit", 20))
    add("definitions", arg("name"))
    add("export", whole("--limit", 1000))
    add("subgraph", arg("node_id"), whole("--depth", 2))
    add("grep", arg("pattern"), whole("--limit", 10), whole("--context", 3), arg("--ext", action="append"), arg("--path"))
    add("complexity", arg("node_id"))
    add("dead")
    add("blast", arg("paths", nargs="*"), whole("--depth", 3), arg("--direction", default="inbound"), arg("--base"))
    add("arch", arg("--aspects", default=""), arg("--scope"), whole("--top", 20))
    add("cypher", arg("query"), arg("--sane", action="store_true"))
    add("trace", arg("name"), arg("--direction", default="inbound"), whole("--depth", 3))
    add("sem-similar", arg("name"), whole("-n", 5))
    add("http-routes", arg("--framework"), arg("--method"))
    add("cross-service", arg("--other"), arg("--min", type=float, default=0.5))
    add("projects", arg("folder"))
    add("serve")
    return p


def show(result: object) -> None:
    if isinstance(result, DataFrame):
        print("\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in result.limit(rpc.MAX_ROWS).collect()))
    elif isinstance(result, dict) and any(isinstance(v, DataFrame) for v in result.values()):
        for k, v in result.items():
            print(f"# {k}")
            show(v)
    elif isinstance(result, tuple):
        for x in result:
            show(x)
    elif isinstance(result, str):
        print(result)
    elif not isinstance(result, bool):
        print(json.dumps(result, default=str))


def run(a: argparse.Namespace, spark: SparkSession) -> object:
    e = GraphEngine(spark, a.db, root=a.root, unique_ids=a.unique_ids)
    way = a.direction if getattr(a, "direction", None) in DIRECTIONS else "inbound"
    match a.command:
        case "build":
            return e.update(a.root) if a.incremental else e.build(a.root)
        case "coverage":
            return e.index_coverage(a.prefix)
        case "stats":
            return e.stats()
        case "search":
            return e.search(a.query, a.limit).drop("extra")
        case "definitions":
            return e.find_definitions(a.name).drop("extra")
        case "export":
            return export_json(e.graph, a.limit)
        case "subgraph":
            g = e.subgraph(a.node_id, a.depth)
            return {"nodes": g.nodes.drop("extra"), "edges": g.edges}
        case "grep":
            return e.search_code(a.pattern, limit=a.limit, context=a.context, extensions=a.ext, path_regex=a.path)
        case "complexity":
            return e.complexity(a.node_id)
        case "dead":
            return e.dead_code()
        case "blast":
            return e.blast_radius(a.paths or None, a.depth, way, a.base)
        case "arch":
            return e.architecture_overview(parse_aspects(a.aspects), a.scope, a.top)
        case "cypher":
            return e.cypher(a.query, "sane" if a.sane else "strict")[0]
        case "trace":
            return e.trace_path(a.name, way, a.depth)
        case "sem-similar":
            return e.similar(a.name, a.n)
        case "http-routes":
            return e.http_routes(a.framework, a.method)
        case "cross-service":
            return e.cross_service(GraphEngine(spark, a.other, read_only=True) if a.other else None, a.min)
        case "projects":
            return projects(spark, a.folder)
    rpc.serve(e)
    return True


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkquiver").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        show(run(a, spark))
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
