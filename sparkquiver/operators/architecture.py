"""The architecture report: a row set for each aspect, optionally within a scope of paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.functions.paths import entry_point_loose, package_of
from sparkquiver.graph import Graph
from sparkquiver.operators import traverse
from sparkquiver.operators.analytics import is_entry
from sparkquiver.operators.components import connected_components
from sparkquiver.schema import InvalidRequest

ASPECTS = ("overview", "structure", "dependencies", "routes", "languages", "packages", "entry_points", "hotspots", "boundaries", "layers", "file_tree", "clusters", "cycles")
DEFAULT_ASPECTS = ASPECTS[:11]
_ALIASES = {"deps": "dependencies", "langs": "languages", "pkgs": "packages", "filetree": "file_tree"}


def parse_aspects(text: str) -> list[str]:
    """Names split at commas, with - or _, and their short forms; unknown names go, none at all is the default set."""
    names = [x.strip().lower().replace("-", "_") for x in text.split(",")]
    out = [_ALIASES.get(x, x) for x in names]
    return list(dict.fromkeys(x for x in out if x in ASPECTS)) or list(DEFAULT_ASPECTS)


@dataclass(frozen=True)
class Scoped:
    """A graph's nodes and edges under a path: an edge counts where either end does."""

    graph: Graph
    scope: str | None = None

    def __post_init__(self) -> None:
        if self.scope and any(c in self.scope for c in "';\\"):
            raise InvalidRequest(f"invalid scope {self.scope!r}")

    def inside(self, c: Column | None = None) -> Column:
        path = F.col("file_path") if c is None else c
        return F.lit(True) if not self.scope else (path == self.scope) | path.ilike(f"{self.scope}/%")

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes.where(self.inside())

    @property
    def ends(self) -> DataFrame:
        """Edges with the file and language of both ends, the target's null where it isn't a node. Parallel edges are one row, n says
        how many: they are counted before the joins, so that a node which very many of them share is no task's burden."""
        n = self.graph.nodes
        s = n.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"), F.col("language").alias("source_language"))
        t = n.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
        e = self.graph.edges.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n")).join(s, "source").join(t, "target", "left")
        return e if not self.scope else e.where(self.inside(F.col("source_file")) | F.coalesce(self.inside(F.col("target_file")), F.lit(False)))


def overview(s: Scoped) -> DataFrame:
    """One row of counts. A scope is a plain prefix here, and edges don't heed it."""
    n = s.graph.nodes if not s.scope else s.graph.nodes.where(F.col("file_path").ilike(s.scope + "%"))
    nodes = n.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
        F.count_if(F.col("kind").isin("class", "struct", "trait", "interface")).alias("types"),
        F.count_distinct("language").alias("languages"),
        F.count_if(is_entry()).alias("entry_points"),
        F.count_distinct("file_path").alias("node_files"),
    )
    edges = s.graph.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "calls").alias("call_edges"))
    if s.scope:
        return nodes.join(edges, F.lit(True)).withColumnRenamed("node_files", "files")
    files = s.graph.files.agg(F.count(F.lit(1)).alias("files"))
    return nodes.drop("node_files").join(edges, F.lit(True)).join(files, F.lit(True))


def structure(s: Scoped) -> DataFrame:
    """(path, node_count, edge_count) of each package; its edges join two files of it."""
    files = s.nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    nodes = files.groupBy(package_of(F.col("file_path")).alias("path")).agg(F.sum("n").alias("node_count"))
    e = s.ends.where(F.col("target_file").isNotNull() & s.inside(F.col("source_file")) & s.inside(F.col("target_file")) & (F.col("source_file") != F.col("target_file")))
    e = e.groupBy("source_file", "target_file").agg(F.sum("n").alias("n"))
    e = e.select(package_of(F.col("source_file")).alias("path"), package_of(F.col("target_file")).alias("to"), "n").where("path = to")
    e = e.groupBy("path").agg(F.sum("n").alias("edge_count"))
    return nodes.join(e, "path", "left").select("path", "node_count", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count")).orderBy(F.col("node_count").desc(), "path")


def packages(s: Scoped, top_n: int = 20) -> DataFrame:
    return structure(s).limit(max(1, top_n))


def dependencies(s: Scoped, top_n: int = 20) -> DataFrame:
    e = s.ends.where((F.col("kind") == "imports") & (F.col("source_file") != F.col("target_file")))
    return e.groupBy(F.col("source_file").alias("from_file"), F.col("target_file").alias("to_file")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "from_file", "to_file").limit(max(1, top_n))


def routes(s: Scoped, strict: bool = False) -> DataFrame:
    """Route nodes by file and line. strict looks method and path up under the short keys, which no parser writes."""
    pre = "" if strict else "http."
    look = lambda k: F.try_element_at("extra", F.lit(pre + k))
    return s.nodes.where("kind = 'route'").select("name", "file_path", "start_line", look("method").alias("method"), look("path").alias("path"), F.try_element_at("extra", F.lit("http.framework")).alias("framework")).orderBy("file_path", "start_line", "name")


def languages(s: Scoped) -> DataFrame:
    n = s.nodes.groupBy("language").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))
    e = s.ends.groupBy(F.col("source_language").alias("language")).agg(F.sum("n").alias("edges"))
    return n.join(e, "language", "left").select("language", "nodes", "files", F.coalesce("edges", F.lit(0)).cast("long").alias("edges")).orderBy("language")


def _loose() -> Column:
    return entry_point_loose(F.col("name"), F.col("file_path"), F.col("is_exported"), F.col("visibility"))


def entry_points(s: Scoped, limit: int = 200) -> DataFrame:
    return s.nodes.where(_loose()).select("id", "name", "kind", "file_path").orderBy("file_path", "name", "id").limit(limit)


def hotspots(s: Scoped, top_n: int = 20) -> DataFrame:
    calls = s.graph.edges.where("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return s.nodes.join(calls, "id").select("id", "name", "qualified_name", "file_path", "in_degree").orderBy(F.col("in_degree").desc(), "qualified_name", "id").limit(max(1, top_n))


def boundaries(s: Scoped, top_n: int = 20) -> DataFrame:
    """(path, outbound, inbound, ratio) of calls between files of different packages; ratio is the outbound share."""
    e = s.ends.where((F.col("kind") == "calls") & (F.col("source_file") != F.col("target_file"))).select(package_of(F.col("source_file")).alias("p"), package_of(F.col("target_file")).alias("q"), "n").where("p <> q")
    out = e.groupBy(F.col("p").alias("path")).agg(F.sum("n").alias("outbound"))
    into = e.groupBy(F.col("q").alias("path")).agg(F.sum("n").alias("inbound"))
    both = out.join(into, "path", "full_outer").select("path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outbound", "inbound")])
    return both.withColumn("ratio", F.col("outbound") / (F.col("outbound") + F.col("inbound"))).orderBy((F.col("outbound") + F.col("inbound")).desc(), "path").limit(max(1, top_n))


def layer_histogram(s: Scoped) -> DataFrame:
    """(layer, n, cyclic): how many nodes lie on each layer of calls below the entry points."""
    found = traverse.layers(s.graph, s.nodes.where(_loose()).select("id"), s.inside() if s.scope else None)
    return found.groupBy("layer", "cyclic").agg(F.count(F.lit(1)).alias("n")).select("layer", "n", "cyclic").orderBy("layer")


def file_tree(s: Scoped) -> DataFrame:
    """(name, children): top directories with the base names of all files below them, sorted; files at the root are left out."""
    parts = F.split("file_path", "/")
    leaf = s.nodes.select("file_path").distinct().where(F.size(parts) > 1).select(F.element_at(parts, 1).alias("name"), F.element_at(parts, -1).alias("leaf")).distinct()
    return leaf.groupBy("name").agg(F.sort_array(F.collect_list("leaf")).alias("children")).orderBy("name")


def clusters(s: Scoped) -> DataFrame:
    """(id, cluster): connected components of call edges, each named by its smallest id."""
    return connected_components(s.graph.edges.where("kind = 'calls'"), "source", "target").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def architecture_overview(graph: Graph, aspects: list[str] | None = None, scope: str | None = None, top_n: int = 20) -> dict[str, DataFrame]:
    s = Scoped(graph, scope)
    made = {
        "overview": lambda: overview(s), "structure": lambda: structure(s), "dependencies": lambda: dependencies(s, top_n), "routes": lambda: routes(s),
        "languages": lambda: languages(s), "packages": lambda: packages(s, top_n), "entry_points": lambda: entry_points(s), "hotspots": lambda: hotspots(s, top_n),
        "boundaries": lambda: boundaries(s, top_n), "layers": lambda: layer_histogram(s), "file_tree": lambda: file_tree(s), "clusters": lambda: clusters(s),
    }
    return {a: made[a]() for a in aspects or DEFAULT_ASPECTS if a in made}
