"""Traversals: level loops of one join and one distinct, cut by a checkpoint, that stop when a level is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.graph import Graph
from sparkquiver.operators.components import FEW, cut, if_few
from sparkquiver.schema import SEED_KINDS, InvalidRequest, NotFound

DIRECTIONS = ("inbound", "outbound", "both")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there) steps of a direction."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    if direction == "outbound":
        return out
    if direction == "inbound":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise InvalidRequest(f"unknown direction {direction!r}")


def distances(seeds: DataFrame, steps: DataFrame, depth: int, through: DataFrame | None = None) -> DataFrame:
    """(id, depth): the least number of steps from any of the seeds (id), up to depth. Where given, only ids of `through` count.

    A level of few nodes is sent to the steps, which are then only scanned; they are told apart and stored for the first level that
    is larger."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    level, steps, stored = seen, steps.where("here is not null and there is not null"), False
    now = level.count()
    for d in range(1, depth + 1):
        few = now <= FEW
        if not (few or stored):
            steps, stored = cut(steps.distinct()), True
        here = level.select(F.col("id").alias("here"))
        reached = steps.join(F.broadcast(here) if few else here, "here").select(F.col("there").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        if through is not None:
            reached = cut(reached)
            reached = through.select("id").join(if_few(reached), "id", "left_semi").distinct()
        level = cut(reached.withColumn("depth", F.lit(d)))
        now = level.count()
        if not now:
            break
        seen = seen.unionByName(level)
    return seen


def reachable_calls(graph: Graph, seeds: DataFrame, depth: int, direction: str = "inbound") -> DataFrame:
    """Nodes within depth call steps of the seeds (id), without the seeds; both is inbound and outbound, each on its own."""
    if direction not in DIRECTIONS:
        raise InvalidRequest(f"unknown direction {direction!r}")
    calls = graph.edges.where("kind = 'calls'")
    ways = ("inbound", "outbound") if direction == "both" else (direction,)
    ids = reduce(DataFrame.unionByName, [distances(seeds, directed(calls, w), max(0, depth)).select("id") for w in ways]).distinct()
    return graph.nodes.join(ids.join(seeds.select("id"), "id", "left_anti"), "id", "left_semi")


def seeds_of_files(graph: Graph, paths: list[str]) -> DataFrame:
    """(path, place, nodes): definitions in each path, in the order of the request."""
    asked = graph.spark.createDataFrame(list(enumerate(paths)), "place int, path string")
    found = graph.nodes.where(F.col("kind").isin(*SEED_KINDS)).join(F.broadcast(asked), F.col("file_path") == F.col("path"))
    return found.select("place", "path", "id", "kind", "name", "qualified_name", "start_line")


def blast_radius(graph: Graph, paths: list[str], depth: int = 3, direction: str = "inbound") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, impacted nodes, impacted files)."""
    seeds = seeds_of_files(graph, paths)
    hit = reachable_calls(graph, seeds.select("id"), depth, direction)
    return seeds, hit, hit.select("file_path").distinct().orderBy("file_path")


def relations(graph: Graph, node_id: str, depth: int, direction: str) -> DataFrame:
    """Callers (inbound) or callees (outbound): a row for every edge at a node less than depth steps away, with the node at its
    other end; depth is the shortest, plus one. Edges of every kind count."""
    if graph.nodes.where(F.col("id") == node_id).isEmpty():
        raise NotFound(node_id)
    root = graph.nodes.where(F.col("id") == node_id).select("id")
    steps = directed(graph.edges, direction)
    known = graph.nodes.select("id")
    reach = distances(root, steps, max(0, depth - 1), through=known)
    here, there = ("source", "target") if direction == "outbound" else ("target", "source")
    e = graph.edges.select(F.col(here).alias("id"), F.col(there).alias("other"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line"), F.col("seq").alias("edge_seq"))
    n = graph.nodes.select(F.col("id").alias("other"), "name", "kind", "qualified_name", "file_path")
    if depth < 1:
        reach = reach.where("false")
    # Few nodes can have very many edges between them, which would meet in as few tasks if they were shuffled.
    reach = if_few(reach)
    others = cut(e.join(reach.select("id"), "id", "left_semi").select("other").distinct())
    if others.limit(FEW + 1).count() <= FEW:
        n = if_few(cut(n.join(F.broadcast(others), "other", "left_semi")))
    return e.join(reach, "id").join(n, "other").select(F.col("other").alias("node_id"), "name", "kind", "qualified_name", "file_path", "edge_kind", "edge_line", (F.col("depth") + 1).alias("depth"))


def callers(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return relations(graph, node_id, depth, "inbound")


def callees(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return relations(graph, node_id, depth, "outbound")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among distinct ids; parallel edges stay."""
    s, t = (if_few(ids.select(F.col("id").alias(c))) for c in ("_s", "_t"))
    marked = edges.join(s, F.col("source") == F.col("_s"), "left").join(t, F.col("target") == F.col("_t"), "left")
    return marked.where("_s is not null or _t is not null").select(*edges.columns)


def subgraph(graph: Graph, node_id: str, depth: int = 2) -> Graph:
    """Nodes within depth steps either way, and every edge at one of them; the node itself need not exist."""
    root = graph.spark.createDataFrame([(node_id,)], "id string")
    ids = distances(root, directed(graph.edges, "both"), depth).select("id")
    nodes = graph.nodes.join(if_few(ids), "id", "left_semi")
    return Graph(nodes, incident(graph.edges, ids), graph.files, graph.coverage)


def bfs(graph: Graph, starts: list[str], max_depth: int) -> Graph:
    """Breadth first, either way: edges at nodes nearer than max_depth; ends that aren't nodes are walked through but not returned."""
    roots = graph.spark.createDataFrame([(s,) for s in starts], "id string")
    reach = distances(roots, directed(graph.edges, "both"), max_depth)
    inner = reach.where(F.col("depth") < max_depth).select("id")
    nodes = graph.nodes.join(reach.select("id"), "id", "left_semi")
    return Graph(nodes, incident(graph.edges, inner))


def impact_analysis(graph: Graph, node_id: str, depth: int) -> DataFrame:
    """(role, depth, id, name, file_path): callers and callees over edges of every kind, each once at its least depth; only nodes
    that exist are walked on from, but for the root."""
    root = graph.spark.createDataFrame([(node_id,)], "id string")
    n = graph.nodes.select("id", "name", "file_path")
    parts = []
    for role, way in (("caller", "inbound"), ("callee", "outbound")):
        reach = distances(root, directed(graph.edges, way), depth, through=graph.nodes.select("id")).where("depth > 0")
        parts.append(n.join(if_few(reach), "id").select(F.lit(role).alias("role"), "depth", "id", "name", "file_path"))
    return parts[0].unionByName(parts[1])


def layers(graph: Graph, entries: DataFrame, scoped: Column | None = None) -> DataFrame:
    """(id, layer, cyclic): the longest walk of calls from an entry (id). Where a cycle can be reached, no walk is longest: layers are
    then the shortest ways, marked cyclic."""
    calls = graph.edges.where("kind = 'calls'").select(F.col("source").alias("here"), F.col("target").alias("there")).distinct()
    nodes = graph.nodes.where(scoped) if scoped is not None else graph.nodes
    calls = cut(calls.join(nodes.select(F.col("id").alias("there")), "there", "left_semi"))
    shortest = cut(distances(entries, calls, 1 << 30))
    left = cut(calls.join(shortest.select(F.col("id").alias("here")), "here", "left_semi"))
    # All that is left hangs on entries, so a node that no call leads to is one, and a node whose callers are all gone after d
    # rounds ends a longest walk of d calls. Each round reads only the calls that are left.
    found, before, d = [], left.count(), 0
    while before:
        reached = left.select(F.col("there").alias("here")).distinct()
        rest = cut(left.join(reached, "here", "left_semi"))
        now = rest.count()
        if now == before:
            return shortest.select("id", F.col("depth").alias("layer"), F.lit(True).alias("cyclic"))
        d += 1
        found.append(cut(reached.join(rest.select(F.col("there").alias("here")).distinct(), "here", "left_anti").select(F.col("here").alias("id"), F.lit(d).alias("layer"))))
        left, before = rest, now
    below = reduce(DataFrame.unionByName, found, shortest.select("id", F.lit(0).alias("layer")).where("false"))
    top = entries.select("id").distinct().join(below, "id", "left_anti").select("id", F.lit(0).alias("layer"))
    return below.unionByName(top).select("id", "layer", F.lit(False).alias("cyclic"))
