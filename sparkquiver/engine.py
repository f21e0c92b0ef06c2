"""GraphEngine: one object over a graph or a store, with every operation of the library."""

from __future__ import annotations

import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver import schema
from sparkquiver.functions.hashes import content_hash
from sparkquiver.functions.paths import LANGUAGES, language_of
from sparkquiver.graph import Graph, complete, empty_graph
from sparkquiver.operators import analytics, architecture, http, incremental, resolve, search, similarity, traverse
from sparkquiver.operators.components import cut
from sparkquiver.plans.compiler import compile_query, truncated
from sparkquiver.plans.parser import parse_cypher
from sparkquiver.sources.scanner import parse_file
from sparkquiver.sources.store import GraphStore
from sparkquiver.sources.walk import MAX_BYTES, changed_paths, read_files


def parse_files(files: DataFrame, unique_ids: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, coverage) of files (path, size_bytes, text, language): each is scanned where its text lies."""

    def run(batches):
        import json

        import pandas as pd

        n_cols, e_cols = schema.columns(schema.NODE), schema.columns(schema.EDGE)
        node = {"qualified_name": "", "start_column": 0, "end_column": 0, "is_exported": False, "is_async": False, "is_static": False, "is_abstract": False, "extra": {}, "seq": 0}
        for pdf in batches:
            out = []
            for path, size, text, language in zip(pdf["path"], pdf["size_bytes"], pdf["text"], pdf["language"]):
                if text is None:
                    skipped = size > MAX_BYTES
                    out.append(("coverage", None, path, "skipped" if skipped else "parse_error", "file too large" if skipped else "file can't be read as UTF-8"))
                    continue
                try:
                    p = parse_file(path, text, language, unique_ids)
                except Exception as e:  # a file that can't be read is reported, and the others go on
                    out.append(("coverage", None, path, "parse_error", str(e)))
                    continue
                out += [("node", json.dumps({c: (node | x).get(c) for c in n_cols}), path, None, None) for x in p.nodes]
                out += [("edge", json.dumps({c: x.get(c) for c in e_cols}), path, None, None) for x in p.edges]
                out.append(("coverage", None, path, "indexed", None))
            yield pd.DataFrame(out, columns=["tag", "body", "path", "status", "reason"])

    rows = cut(files.select("path", "size_bytes", "text", "language").mapInPandas(run, "tag string, body string, path string, status string, reason string"))
    order = F.xxhash64("language", "file_path", "id")
    nodes = rows.where("tag = 'node'").select(F.from_json("body", schema.NODE).alias("n")).select("n.*").withColumn("seq", order)
    edges = rows.where("tag = 'edge'").select(F.from_json("body", schema.EDGE).alias("e")).select("e.*").withColumn("seq", F.xxhash64("id"))
    now = int(time.time())
    info = files.select("path", "language", "size_bytes")
    coverage = rows.where("tag = 'coverage'").select("path", "status", "reason").join(info, "path").withColumn("indexed_at", F.lit(now).cast("long"))
    return complete(nodes, schema.NODE), complete(edges, schema.EDGE), complete(coverage, schema.COVERAGE)


class GraphEngine:
    name = "sparkquiver"

    def __init__(self, spark: SparkSession, store: str | Path | None = None, graph: Graph | None = None, read_only: bool = False, root: str | Path | None = None, unique_ids: bool = False) -> None:
        """unique_ids puts the path into node ids, so that definitions of one kind, name and line in two files stay apart."""
        self.spark, self.root, self.unique_ids = spark, root, unique_ids
        self.store = GraphStore(spark, store, read_only) if store is not None else None
        self._graph = graph

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = self.store.read() if self.store is not None else empty_graph(self.spark)
        return self._graph

    def _save(self, g: Graph) -> None:
        if self.store is not None:
            self.store.write(g)
            g = None
        self._graph = g

    @staticmethod
    def supported_languages() -> list[str]:
        return sorted(set(LANGUAGES.values()))

    @staticmethod
    def lang_name_for_path(path: str) -> str | None:
        name = path.rpartition("/")[2]
        return LANGUAGES.get(name.rpartition(".")[2]) if "." in name else None

    # Building

    def _snapshot(self, root: str | Path, paths: list[str] | None = None) -> DataFrame:
        files = read_files(self.spark, root, paths).withColumn("language", language_of(F.col("path"))).where("language is not null")
        return cut(files.withColumn("content_hash", content_hash("text")))

    def build(self, root: str | Path, semantic: bool = True) -> dict[str, int]:
        """Index a tree anew: scan files, resolve names, and relate similar definitions."""
        self.root = root
        files = self._snapshot(root)
        nodes, edges, coverage = parse_files(files, self.unique_ids)
        nodes = cut(resolve.last_wins(nodes, ["id"], "seq").select(*schema.columns(schema.NODE)))
        edges = cut(resolve.resolve_references(nodes, edges))
        table = complete(files.select("path", "language", "mtime", "content_hash", F.lit(int(time.time())).alias("indexed_at")), schema.FILE)
        g = Graph(nodes, edges, table, cut(coverage))
        if semantic:
            g = self.relate(g)
        self._save(g)
        return self._counts()

    def relate(self, g: Graph) -> Graph:
        """g with its similarity edges, and the vectors that they come from, made anew."""
        vec, pairs = similarity.related(g)
        new = complete(similarity.as_edges(pairs), schema.EDGE).withColumn("seq", F.xxhash64("id"))
        return Graph(g.nodes, cut(g.edges.where("kind <> 'semantically_related'").unionByName(new)), g.files, g.coverage, complete(vec, schema.EMBEDDING), g.postings)

    def update(self, root: str | Path) -> dict:
        """Index what changed since the last time; without an index, everything."""
        if self.graph.files.isEmpty():
            return {"status": "built", **self.build(root)}
        snapshot = self._snapshot(root)
        diff = cut(incremental.diff_files(self.graph.files, snapshot))
        counts = {r["action"]: r["n"] for r in diff.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = sum(counts.get(a, 0) for a in ("changed", "added", "removed"))
        if not touched:
            return {"status": "no_changes", "changed": 0}
        self._replace(snapshot, diff)
        return {"status": "updated", "changed": touched, **self._counts()}

    def update_files(self, root: str | Path, paths: list[str]) -> dict:
        """Index just these paths; those that are gone lose their nodes and edges."""
        snapshot = self._snapshot(root, paths).where("size_bytes >= 0")
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        diff = asked.join(snapshot.select("path", F.lit(1).alias("here")), "path", "left").select("path", F.when(F.col("here").isNull(), "removed").otherwise("changed").alias("action"))
        self._replace(snapshot, cut(diff))
        return {"changed": len(paths), **self._counts()}

    def _replace(self, snapshot: DataFrame, diff: DataFrame) -> None:
        fresh = snapshot.join(diff.where("action in ('changed', 'added')").select("path"), "path", "left_semi")
        gone = diff.where("action in ('changed', 'removed')").select("path")
        nodes, edges, coverage = parse_files(fresh, self.unique_ids)
        g = incremental.replace_files(self.graph, gone, nodes, edges)
        refreshed = snapshot.join(diff.where("action <> 'skip'").select("path"), "path", "left_semi")
        table = complete(refreshed.select("path", "language", "mtime", "content_hash", F.lit(int(time.time())).alias("indexed_at")), schema.FILE)
        files = self.graph.files.join(diff.where("action <> 'skip'").select("path"), "path", "left_anti").unionByName(table)
        old = self.graph.coverage.join(diff.where("action in ('changed', 'added', 'removed')").select("path"), "path", "left_anti")
        self._save(Graph(cut(g.nodes), cut(g.edges), cut(files), cut(old.unionByName(coverage)), *self._kept(g)))

    def _kept(self, g: Graph) -> tuple[DataFrame | None, DataFrame | None]:
        """The vectors and the search index for g: what changed since is put in anew, vectors from the definitions alone until
        they are related again."""
        vectors, index = self.graph.embeddings, self.graph.postings
        if vectors is not None:
            said = lambda d: d.select("id", F.struct("kind", "name", "signature").alias("said"))
            same = said(self.graph.nodes).intersect(said(g.nodes)).select("id")
            fresh = similarity.provisional_vectors(g.nodes.join(same, "id", "left_anti"))
            vectors = cut(vectors.join(same, "id", "left_semi").unionByName(complete(fresh, schema.EMBEDDING)))
        return vectors, None if index is None else cut(search.updated_index(index, self.graph.nodes, g.nodes))

    def _counts(self) -> dict[str, int]:
        r = analytics.stats(self.graph).first()
        return {"files": r["total_files"], "nodes": r["total_nodes"], "edges": r["total_edges"]}

    def clear(self) -> None:
        if self.store is not None:
            self.store.clear()
        self._graph = None

    # Reading

    def graph_data(self) -> Graph:
        return self.graph

    def stats(self) -> DataFrame:
        return analytics.stats(self.graph)

    def index_coverage(self, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
        return analytics.coverage_counts(self.graph, prefix), analytics.coverage_entries(self.graph, prefix)

    def search(self, text: str, limit: int = 50) -> DataFrame:
        return search.search_nodes(self.graph, text, limit)

    def find_definitions(self, name: str) -> DataFrame:
        return search.find_definitions(self.graph, name)

    def node_by_id(self, node_id: str) -> DataFrame:
        return self.graph.nodes.where(F.col("id") == node_id)

    def edges_for_node(self, node_id: str) -> DataFrame:
        return self.graph.edges.where((F.col("source") == node_id) | (F.col("target") == node_id))

    def subgraph(self, node_id: str, depth: int = 2) -> Graph:
        return traverse.subgraph(self.graph, node_id, depth)

    def search_code(self, pattern: str, root: str | Path | None = None, **options) -> DataFrame:
        at = root or self.root
        if at is None:
            raise schema.InvalidRequest("code search needs the project's root")
        return search.code_search(self.graph, read_files(self.spark, at), pattern, **options)

    def complexity(self, node_id: str) -> DataFrame:
        return analytics.complexity(self.graph, node_id)

    def dead_code(self) -> tuple[DataFrame, DataFrame]:
        return analytics.dead_code_report(self.graph), analytics.dead_code(self.graph)

    def blast_radius(self, paths: list[str] | None = None, depth: int = 3, direction: str = "inbound", base: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        if paths is None:
            paths = changed_paths(self.root or ".", base)
        return traverse.blast_radius(self.graph, paths, depth, direction)

    def callers(self, node_id: str, depth: int = 1) -> DataFrame:
        return traverse.callers(self.graph, node_id, depth)

    def callees(self, node_id: str, depth: int = 1) -> DataFrame:
        return traverse.callees(self.graph, node_id, depth)

    def trace_path(self, name: str, direction: str = "inbound", depth: int = 3) -> DataFrame:
        """Relations of the one definition of a name; its candidates where there are none or several."""
        found = self.find_definitions(name)
        ids = [r["id"] for r in found.select("id").collect()]  # find_definitions gives 50 at most
        return traverse.relations(self.graph, ids[0], depth, direction) if len(ids) == 1 else found

    def architecture_overview(self, aspects: list[str] | None = None, scope: str | None = None, top_n: int = 20) -> dict[str, DataFrame]:
        return architecture.architecture_overview(self.graph, aspects, scope, top_n)

    def cypher(self, text: str, mode: str = "strict") -> tuple[DataFrame, bool]:
        """(rows, whether LIMIT may have cut them)."""
        q = parse_cypher(text)
        rows = compile_query(self.graph, q, mode)
        return rows, truncated(self.graph, q, rows)

    def route_records_by_role(self, role: str) -> DataFrame:
        return http.route_records(self.graph, role)

    def http_routes(self, framework: str | None = None, method: str | None = None) -> DataFrame:
        return http.http_routes(self.graph, framework, method)

    def cross_service(self, other: "GraphEngine | None" = None, least: float = 0.5) -> DataFrame:
        return http.cross_service(self.route_records_by_role("server"), (other or self).route_records_by_role("client"), least)

    def similar(self, name: str, n: int = 5) -> DataFrame:
        """Definitions most like a name's first one, by their stored vectors; a graph that has none gets them first."""
        if self.graph.embeddings is None or self.graph.embeddings.isEmpty():
            self._save(self.relate(self.graph))
        return similarity.similar_by_name(self.graph, self.graph.embeddings, name, n)

    # Parts of the store

    def file_paths(self) -> DataFrame:
        return self.graph.files.select("path")

    def file_record(self, path: str) -> DataFrame:
        return self.graph.files.where(F.col("path") == path)

    def edge_sources_pointing_to(self, ids: list[str]) -> DataFrame:
        return incremental.edge_sources_pointing_to(self.graph, self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete(self, what: str, value: str) -> None:
        """Delete by what: nodes_of_kind, edges_of_kind, edges_from (a source), incident (to a node), file (nodes and edges of a path),
        file_record or coverage (of a path)."""
        g = incremental.deleted(self.graph, what, value)
        embeddings, postings = self._kept(g)
        self._save(replace(g, embeddings=embeddings, postings=postings))
