"""The registered queries over the driver's tables, each with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver import schema
from sparkquiver.functions import hashes, paths, text, vectors
from sparkquiver.graph import Graph, complete
from sparkquiver.operators import analytics, architecture, http, incremental, resolve, search, similarity, traverse
from sparkquiver.operators.architecture import Scoped
from sparkquiver.operators.components import stored
from sparkquiver.plans.adapter import GRAPH_SQL, document_path, stored_graph
from sparkquiver.plans.compiler import run_cypher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a function of (graph) or of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(stored_graph(spark, sf_dir))) if graph else f
        if sql is not None:
            ORACLE[f.__name__] = (GRAPH_SQL if graph else "") + sql
        return f

    return add


def cypher(name: str, statement: str, sql: str, mode: str = "strict") -> None:
    QUERIES[name] = lambda spark, sf_dir: run_cypher(stored_graph(spark, sf_dir), statement, mode)
    ORACLE[name] = GRAPH_SQL + sql


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Cypher ---------------------------------------------------------------------------------------------------------------

FLAGSHIP = "MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.name STARTS WITH 'Customer' RETURN a.name AS caller, b.name AS callee"
_EDGE = "FROM nodes a JOIN edges e ON e.source = a.id JOIN nodes b ON b.id = e.target"
_F = "FROM nodes n WHERE kind = 'function'"

cypher("cypher_edge", FLAGSHIP, f"SELECT a.name AS caller, b.name AS callee {_EDGE} WHERE e.kind = 'calls' AND a.kind = 'function' AND b.kind = 'function' AND starts_with(a.name, 'Customer')")
cypher("cypher_match_label", "MATCH (n:Module) RETURN n.id AS id, n.name AS name, n.file_path AS path", "SELECT id, name, file_path AS path FROM nodes WHERE kind = 'module'")
cypher("cypher_any_edge", "MATCH (a:Namespace)-[e]->(b) RETURN a.name AS a, b.name AS b, e.kind AS k", f"SELECT a.name AS a, b.name AS b, NULL::VARCHAR AS k {_EDGE} WHERE a.kind = 'namespace'")
cypher("cypher_where_eq", "MATCH (n:Function) WHERE n.language = 'rust' RETURN n.name AS name", f"SELECT name {_F} AND language = 'rust'")
cypher("cypher_where_ne", "MATCH (n:Function) WHERE n.language != 'rust' RETURN n.name AS name", f"SELECT name {_F} AND language <> 'rust'")
cypher("cypher_where_lt", "MATCH (n:Class) WHERE n.start_line < 100 RETURN n.id AS id, n.start_line AS line", "SELECT id, start_line::BIGINT AS line FROM nodes WHERE kind = 'class' AND start_line < 100")
cypher("cypher_where_ge", "MATCH (n:Class) WHERE n.end_line >= 900 RETURN n.id AS id", "SELECT id FROM nodes WHERE kind = 'class' AND end_line >= 900")
cypher("cypher_where_starts", "MATCH (n:Struct) WHERE n.file_path STARTS WITH 'asia/' RETURN n.name AS name", "SELECT name FROM nodes WHERE kind = 'struct' AND starts_with(file_path, 'asia/')")
cypher("cypher_where_contains", "MATCH (n) WHERE n.qualified_name CONTAINS '99' RETURN n.id AS id", "SELECT id FROM nodes WHERE contains(qualified_name, '99')")
cypher("cypher_where_in", "MATCH (n:Function) WHERE n.language IN ['c', 'cpp', 3] RETURN n.id AS id, n.language AS language", f"SELECT id, language {_F} AND language IN ('c', 'cpp')")
cypher("cypher_where_bool", "MATCH (n:Function) WHERE n.is_exported = true RETURN n.id AS id", f"SELECT id {_F} AND is_exported")
cypher("cypher_where_extra", "MATCH (n:Function) WHERE n.segment = 'BUILDING' RETURN n.id AS id, n.segment AS segment", f"SELECT id, segment {_F} AND segment = 'BUILDING'")
cypher("cypher_mixed_eq", "MATCH (n:Function) WHERE n.name = 5 RETURN n.id AS id", f"SELECT id {_F}")
cypher("cypher_mixed_ge_null", "MATCH (n:Struct) WHERE n.nope >= 5 RETURN n.id AS id", "SELECT id FROM nodes WHERE kind = 'struct'")
cypher("cypher_mixed_gt_extra", "MATCH (n:Function) WHERE n.cyclomatic > 5 RETURN n.id AS id", f"SELECT id {_F} AND false")
cypher("cypher_sane_mixed", "MATCH (n:Function) WHERE n.name = 5 RETURN n.id AS id", f"SELECT id {_F} AND false", "sane")
cypher("cypher_self_variable", "MATCH (a:Module)-[:IMPORTS]->(a) RETURN a.name AS name, COUNT(a) AS n", "SELECT a.name, 2::BIGINT AS n FROM nodes a JOIN edges e ON e.source = a.id JOIN nodes b ON b.id = e.target WHERE e.kind = 'imports' AND a.kind = 'module'")
cypher("cypher_optional", "MATCH (a:Function) WHERE a.language = 'c' OPTIONAL MATCH (a)-[:CALLS]->(b:Function) RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, x.name AS b FROM nodes a LEFT JOIN (SELECT e.source, b.name FROM edges e JOIN nodes b ON b.id = e.target WHERE e.kind = 'calls' AND b.kind = 'function') x ON x.source = a.id WHERE a.kind = 'function' AND a.language = 'c'")
cypher("cypher_optional_where", "MATCH (a:Struct) OPTIONAL MATCH (m:Module)-[:Contains]->(a) WHERE m.name STARTS WITH 'A' RETURN a.name AS a, m.name AS m", "SELECT a.name AS a, x.name AS m FROM nodes a LEFT JOIN (SELECT e.target, m.name FROM edges e JOIN nodes m ON m.id = e.source WHERE e.kind = 'contains' AND m.kind = 'module' AND starts_with(m.name, 'A')) x ON x.target = a.id WHERE a.kind = 'struct'")
cypher("cypher_union", "MATCH (a:Function)-[:CALLS]->(b) RETURN b.language AS x UNION MATCH (n:Module) RETURN n.language AS x", "SELECT b.language AS x " + _EDGE + " WHERE e.kind = 'calls' AND a.kind = 'function' UNION ALL (SELECT DISTINCT language FROM nodes WHERE kind = 'module' EXCEPT SELECT b.language " + _EDGE + " WHERE e.kind = 'calls' AND a.kind = 'function')")
cypher("cypher_union_names_differ", "MATCH (n:Module) RETURN n.name UNION MATCH (m:Module) RETURN m.name", """SELECT name AS "n.name" FROM nodes WHERE kind = 'module' UNION ALL SELECT DISTINCT name FROM nodes WHERE kind = 'module'""")
cypher("cypher_union_all", "MATCH (n:Module) RETURN n.name AS x UNION ALL MATCH (n:Namespace) RETURN n.name AS x", "SELECT name AS x FROM nodes WHERE kind IN ('module', 'namespace')")
cypher("cypher_count", "MATCH (n:Function)-[:CALLS]->(m) RETURN COUNT(*) AS total", f"SELECT count(*) AS total {_EDGE} WHERE e.kind = 'calls' AND a.kind = 'function'")
cypher("cypher_limit_count", "MATCH (n:Function) RETURN COUNT(*) AS c LIMIT 7", f"SELECT least(count(*), 7) AS c {_F}")
cypher("cypher_count_with_item", "MATCH (n:Module) RETURN n.name AS name, COUNT(*) AS c", "SELECT name, 1::BIGINT AS c FROM nodes WHERE kind = 'module'")
cypher("cypher_sane_group", "MATCH (m:Module)-[:Contains]->(f:Function) RETURN m.name AS name, COUNT(*) AS c", "SELECT a.name, count(*) AS c " + _EDGE + " WHERE e.kind = 'contains' AND a.kind = 'module' AND b.kind = 'function' GROUP BY a.id, a.name", "sane")
cypher("cypher_sane_distinct", "MATCH (a:Module)-[:IMPORTS]->(b:Module) RETURN DISTINCT a.name AS a, b.name AS b", "SELECT DISTINCT a.name AS a, b.name AS b " + _EDGE + " WHERE e.kind = 'imports'", "sane")
cypher("cypher_strict_distinct", "MATCH (a:Module)-[:IMPORTS]->(b:Module) RETURN DISTINCT a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b " + _EDGE + " WHERE e.kind = 'imports'")
cypher("cypher_order_limit", "MATCH (n:Class) RETURN n.name AS name, n.id AS id ORDER BY n.start_line DESC LIMIT 25", "SELECT name, id FROM nodes WHERE kind = 'class' ORDER BY start_line DESC, seq LIMIT 25")
_WALK = "walk(s, t, d) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'function' UNION SELECT s, e.target, d + 1 FROM walk JOIN edges e ON e.source = t AND e.kind = 'calls' WHERE d < {hi})"
cypher("cypher_varlen_1_3", "MATCH (a:Function)-[:CALLS*1..3]->(b:Function) RETURN a.id AS a, b.id AS b", ", " + _WALK.format(hi=3) + " SELECT DISTINCT s AS a, t AS b FROM walk JOIN nodes b ON b.id = t WHERE d BETWEEN 1 AND 3 AND b.kind = 'function'")
cypher("cypher_varlen_0_2", "MATCH (a:Function)-[:CALLS*0..2]->(b) RETURN a.id AS a, b.id AS b", ", " + _WALK.format(hi=2) + " SELECT DISTINCT s AS a, t AS b FROM walk JOIN nodes b ON b.id = t WHERE d <= 2")

# Traversal ------------------------------------------------------------------------------------------------------------


def _seeds(g: Graph) -> DataFrame:
    return g.nodes.where("kind = 'function' and language = 'c' and is_exported").select("id")


_REACH = """, seeds AS (SELECT id FROM nodes WHERE kind = 'function' AND language = 'c' AND is_exported),
r(id, d) AS (SELECT id, 0 FROM seeds UNION SELECT e.{to}, d + 1 FROM r JOIN edges e ON e.{at} = r.id AND e.kind = 'calls' WHERE d < 3)"""
_IN, _OUT = _REACH.format(to="source", at="target"), _REACH.format(to="target", at="source")
_ANSWER = " SELECT DISTINCT n.id, n.name, n.file_path FROM r JOIN nodes n ON n.id = r.id WHERE r.id NOT IN (SELECT id FROM seeds)"


@query(_IN + _ANSWER)
def blast_inbound(g):
    return traverse.reachable_calls(g, _seeds(g), 3, "inbound").select("id", "name", "file_path")


@query(_OUT + _ANSWER)
def blast_outbound(g):
    return traverse.reachable_calls(g, _seeds(g), 3, "outbound").select("id", "name", "file_path")


@query(_IN + ", o(id, d) AS (SELECT id, 0 FROM seeds UNION SELECT e.target, d + 1 FROM o JOIN edges e ON e.source = o.id AND e.kind = 'calls' WHERE d < 3) SELECT DISTINCT n.id, n.name, n.file_path FROM (SELECT id FROM r UNION SELECT id FROM o) x JOIN nodes n ON n.id = x.id WHERE x.id NOT IN (SELECT id FROM seeds)")
def blast_both(g):
    return traverse.reachable_calls(g, _seeds(g), 3, "both").select("id", "name", "file_path")


_PATHS = ["asia/nation_2/building.rs", "europe/nation_3/bin/machinery.rs", "parts/brand_17.rs"]
_IN_PATHS = "file_path IN (" + ", ".join(f"'{p}'" for p in _PATHS) + ")"
_KINDS = "kind IN (" + ", ".join(f"'{k}'" for k in schema.SEED_KINDS) + ")"


@query(f" SELECT id, kind, name, file_path FROM nodes WHERE {_KINDS} AND {_IN_PATHS}")
def blast_seeds(g):
    return traverse.seeds_of_files(g, _PATHS).select("id", "kind", "name", F.col("path").alias("file_path"))


@query(f", seeds AS (SELECT id FROM nodes WHERE {_KINDS} AND {_IN_PATHS}), r(id, d) AS (SELECT id, 0 FROM seeds UNION SELECT e.source, d + 1 FROM r JOIN edges e ON e.target = r.id AND e.kind = 'calls' WHERE d < 2) SELECT DISTINCT n.file_path FROM r JOIN nodes n ON n.id = r.id WHERE r.id NOT IN (SELECT id FROM seeds)")
def blast_files(g):
    return traverse.blast_radius(g, _PATHS, 2)[2]


_DIST = """, d1(id, d) AS (SELECT 'module:8', 0 UNION SELECT x.there, d + 1 FROM d1 JOIN {steps} x ON x.here = d1.id JOIN nodes n ON n.id = x.there WHERE d < {depth}),
least_d AS (SELECT id, min(d) AS d FROM d1 GROUP BY id)"""
_FORWARD, _BACK = "(SELECT source AS here, target AS there FROM edges)", "(SELECT target AS here, source AS there FROM edges)"


@query(_DIST.format(steps=_BACK, depth=1) + " SELECT n.id AS node_id, n.name, e.kind AS edge_kind, e.line::BIGINT AS edge_line, (l.d + 1)::BIGINT AS depth FROM least_d l JOIN edges e ON e.target = l.id JOIN nodes n ON n.id = e.source WHERE l.d < 2")
def callers(g):
    return traverse.callers(g, "module:8", 2).select("node_id", "name", "edge_kind", F.col("edge_line").cast("long").alias("edge_line"), F.col("depth").cast("long").alias("depth"))


@query(_DIST.format(steps=_FORWARD, depth=1) + " SELECT n.id AS node_id, n.name, e.kind AS edge_kind, e.line::BIGINT AS edge_line, (l.d + 1)::BIGINT AS depth FROM least_d l JOIN edges e ON e.source = l.id JOIN nodes n ON n.id = e.target WHERE l.d < 2")
def callees(g):
    return traverse.callees(g, "module:8", 2).select("node_id", "name", "edge_kind", F.col("edge_line").cast("long").alias("edge_line"), F.col("depth").cast("long").alias("depth"))


_BOTH = "(SELECT source AS here, target AS there FROM edges UNION ALL SELECT target, source FROM edges)"


@query(f", d1(id, d) AS (SELECT 'struct:7', 0 UNION SELECT x.there, d + 1 FROM d1 JOIN {_BOTH} x ON x.here = d1.id WHERE d < 2) SELECT DISTINCT n.id, n.kind FROM d1 JOIN nodes n ON n.id = d1.id")
def subgraph_nodes(g):
    return traverse.subgraph(g, "struct:7", 2).nodes.select("id", "kind")


@query(f", d1(id, d) AS (SELECT 'struct:7', 0 UNION SELECT x.there, d + 1 FROM d1 JOIN {_BOTH} x ON x.here = d1.id WHERE d < 2) SELECT source, target, kind, seq FROM edges WHERE source IN (SELECT id FROM d1) OR target IN (SELECT id FROM d1)")
def subgraph_edges(g):
    return traverse.subgraph(g, "struct:7", 2).edges.select("source", "target", "kind", "seq")


@query(f", d1(id, d) AS (SELECT 'namespace:2', 0 UNION SELECT x.there, d + 1 FROM d1 JOIN {_BOTH} x ON x.here = d1.id WHERE d < 2) SELECT source, target, kind, seq FROM edges WHERE source IN (SELECT id FROM d1 WHERE d < 2) OR target IN (SELECT id FROM d1 WHERE d < 2)")
def bfs_edges(g):
    return traverse.bfs(g, ["namespace:2"], 2).edges.select("source", "target", "kind", "seq")


_IMPACT = """, up(id, d) AS (SELECT 'function:10', 0 UNION SELECT e.source, d + 1 FROM up JOIN edges e ON e.target = up.id JOIN nodes n ON n.id = e.source WHERE d < 3),
down(id, d) AS (SELECT 'function:10', 0 UNION SELECT e.target, d + 1 FROM down JOIN edges e ON e.source = down.id JOIN nodes n ON n.id = e.target WHERE d < 3)
SELECT 'caller' AS role, id, min(d)::BIGINT AS depth FROM up WHERE id <> 'function:10' GROUP BY id UNION ALL SELECT 'callee', id, min(d)::BIGINT FROM down WHERE id <> 'function:10' GROUP BY id"""


@query(_IMPACT)
def impact(g):
    return traverse.impact_analysis(g, "function:10", 3).select("role", "id", F.col("depth").cast("long").alias("depth"))


@query(_DIST.format(steps=_FORWARD, depth=1).replace("module:8", "struct:7") + " SELECT n.id AS node_id, e.kind AS edge_kind, (l.d + 1)::BIGINT AS depth FROM least_d l JOIN edges e ON e.source = l.id JOIN nodes n ON n.id = e.target WHERE l.d < 2 UNION ALL SELECT n.id, e.kind, 1 FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'struct:7'")
def trace_relations(g):
    """Both ways from a supplier: two levels of what it reaches and one of what reaches it."""
    out, back = traverse.relations(g, "struct:7", 2, "outbound"), traverse.relations(g, "struct:7", 1, "inbound")
    return out.unionByName(back).select("node_id", "edge_kind", F.col("depth").cast("long").alias("depth"))


# Analytics ------------------------------------------------------------------------------------------------------------

_ENTRY = "(name IN ('main', 'index', '__init__') OR file_path ILIKE '%/bin/%' OR file_path ILIKE '%/main.%' OR file_path ILIKE '%/index.%' OR is_exported OR coalesce(visibility IN ('public', 'pub'), false))"
_LOOSE = "(name IN ('main', 'index', '__init__') OR regexp_matches(file_path, '/bin/|main[.]|index[.]') OR is_exported OR coalesce(visibility IN ('public', 'pub'), false))"
_PKG = "array_to_string(list_slice(string_split({p}, '/'), 1, least(2, len(string_split({p}, '/')) - 1)), '/')"
_ENDS = ", ends AS MATERIALIZED (SELECT e.*, s.file_path AS sf, s.language AS sl, t.file_path AS tf FROM edges e JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target)"


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def stats_node_kinds(g):
    return analytics.node_kinds(g)


@query("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def stats_edge_kinds(g):
    return analytics.edge_kinds(g)


@query("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(DISTINCT file_path) FROM nodes) AS total_files")
def stats(g):
    return analytics.stats(g)


@query(f"SELECT id, name, file_path FROM nodes n WHERE kind IN ('function', 'method', 'test') AND NOT {_ENTRY} AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'calls' AND e.target = n.id)")
def dead_code(g):
    return analytics.dead_code(g).select("id", "name", "file_path")


@query(f"SELECT sum((kind IN ('function', 'method', 'test'))::INT)::BIGINT AS total_functions, sum({_ENTRY}::INT)::BIGINT AS entry_points, (SELECT count(*) FROM nodes n WHERE kind IN ('function', 'method', 'test') AND NOT {_ENTRY} AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'calls' AND e.target = n.id)) AS dead FROM nodes")
def dead_code_report(g):
    return analytics.dead_code_report(g)


@query("SELECT sum((n_chars <= 8000)::INT)::BIGINT AS indexed, sum((n_chars > 8000)::INT)::BIGINT AS skipped, 0::BIGINT AS parse_error FROM documents WHERE source ILIKE 'SRC1%'", graph=False)
def coverage(spark, sf_dir):
    return analytics.coverage_counts(stored_graph(spark, sf_dir), "SRC1")


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, 'skipped' AS status, 'file too large' AS reason, n_chars AS size_bytes FROM documents WHERE n_chars > 8000", graph=False)
def coverage_skipped(spark, sf_dir):
    return analytics.coverage_entries(stored_graph(spark, sf_dir))


# Architecture ---------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS nodes, sum((kind IN ('function', 'method'))::INT)::BIGINT AS functions, sum((kind IN ('class', 'struct', 'trait', 'interface'))::INT)::BIGINT AS types, count(DISTINCT language) AS languages, sum({_ENTRY}::INT)::BIGINT AS entry_points, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE kind = 'calls') AS call_edges, count(DISTINCT file_path) AS files FROM nodes")
def arch_overview(g):
    return architecture.overview(Scoped(g))


@query(f"SELECT count(*) AS nodes, sum((kind IN ('function', 'method'))::INT)::BIGINT AS functions, sum((kind IN ('class', 'struct', 'trait', 'interface'))::INT)::BIGINT AS types, count(DISTINCT language) AS languages, sum({_ENTRY}::INT)::BIGINT AS entry_points, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE kind = 'calls') AS call_edges, count(DISTINCT file_path) AS files FROM nodes WHERE file_path ILIKE 'asia/nation_2%'")
def arch_overview_scoped(g):
    return architecture.overview(Scoped(g, "asia/nation_2"))


_STRUCTURE = _ENDS + f", n AS (SELECT {_PKG.format(p='file_path')} AS path, count(*) AS node_count FROM nodes GROUP BY 1), e AS (SELECT {_PKG.format(p='sf')} AS path, count(*) AS edge_count FROM ends WHERE tf IS NOT NULL AND sf <> tf AND {_PKG.format(p='sf')} = {_PKG.format(p='tf')} GROUP BY 1) SELECT n.path, node_count, coalesce(edge_count, 0) AS edge_count FROM n LEFT JOIN e ON e.path = n.path"


@query(_STRUCTURE)
def arch_structure(g):
    return architecture.structure(Scoped(g))


@query(_STRUCTURE + " ORDER BY node_count DESC, n.path LIMIT 20")
def arch_packages(g):
    return architecture.packages(Scoped(g))


@query(_ENDS + "SELECT sf AS from_file, tf AS to_file, count(*) AS n FROM ends WHERE kind = 'imports' AND sf <> tf GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def arch_dependencies(g):
    return architecture.dependencies(Scoped(g))


@query(_ENDS + "SELECT sf AS from_file, tf AS to_file, count(*) AS n FROM ends WHERE kind = 'imports' AND sf <> tf AND (sf ILIKE 'asia/%' OR tf ILIKE 'asia/%') GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def arch_dependencies_scoped(g):
    return architecture.dependencies(Scoped(g, "asia"))


@query(_ENDS + "SELECT n.language, nodes, files, coalesce(edges, 0) AS edges FROM (SELECT language, count(*) AS nodes, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1) n LEFT JOIN (SELECT sl, count(*) AS edges FROM ends GROUP BY 1) e ON e.sl = n.language")
def arch_languages(g):
    return architecture.languages(Scoped(g))


@query(f"SELECT id, name, kind, file_path FROM nodes WHERE {_LOOSE} ORDER BY file_path, name, id LIMIT 200")
def arch_entry_points(g):
    return architecture.entry_points(Scoped(g))


@query("SELECT n.id, n.name, n.file_path, c.in_degree FROM nodes n JOIN (SELECT target, count(*) AS in_degree FROM edges WHERE kind = 'calls' GROUP BY 1) c ON c.target = n.id ORDER BY in_degree DESC, qualified_name, n.id LIMIT 20")
def arch_hotspots(g):
    return architecture.hotspots(Scoped(g)).select("id", "name", "file_path", "in_degree")


@query(_ENDS + f", x AS (SELECT {_PKG.format(p='sf')} AS p, {_PKG.format(p='tf')} AS q FROM ends WHERE kind = 'calls' AND sf <> tf) SELECT coalesce(o.p, i.q) AS path, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound, round(coalesce(o.n, 0) / (coalesce(o.n, 0) + coalesce(i.n, 0)), 9) AS ratio FROM (SELECT p, count(*) AS n FROM x WHERE p <> q GROUP BY 1) o FULL JOIN (SELECT q, count(*) AS n FROM x WHERE p <> q GROUP BY 1) i ON o.p = i.q ORDER BY coalesce(o.n, 0) + coalesce(i.n, 0) DESC, path LIMIT 20")
def arch_boundaries(g):
    return architecture.boundaries(Scoped(g)).withColumn("ratio", F.round("ratio", 9))


def _forward(g: Graph) -> Graph:
    """The graph with only those calls that go to a greater customer number, which can't form a cycle."""
    number = lambda c: F.element_at(F.split(c, ":"), 2).cast("long")
    return Graph(g.nodes, g.edges.where((F.col("kind") == "calls") & (number("target") > number("source"))), g.files)


@query(f", calls AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls' AND split_part(target, ':', 2)::BIGINT > split_part(source, ':', 2)::BIGINT), l(id, d) AS (SELECT id, 0 FROM nodes WHERE {_LOOSE} UNION SELECT c.target, d + 1 FROM l JOIN calls c ON c.source = l.id) SELECT d AS layer, count(*) AS n FROM (SELECT id, max(d)::BIGINT AS d FROM l GROUP BY id) GROUP BY d")
def arch_layers(g):
    return architecture.layer_histogram(Scoped(_forward(g))).select(F.col("layer").cast("long").alias("layer"), "n")


@query(f", calls AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'), l(id, d) AS (SELECT id, 0 FROM nodes WHERE {_LOOSE} UNION SELECT c.target, d + 1 FROM l JOIN calls c ON c.source = l.id WHERE d < 60) SELECT d AS layer, count(*) AS n FROM (SELECT id, min(d)::BIGINT AS d FROM l GROUP BY id) GROUP BY d")
def arch_layers_cyclic(g):
    return architecture.layer_histogram(Scoped(g)).select(F.col("layer").cast("long").alias("layer"), "n")


@query("SELECT name, string_agg(leaf, ',' ORDER BY leaf) AS children FROM (SELECT DISTINCT split_part(file_path, '/', 1) AS name, string_split(file_path, '/')[-1] AS leaf FROM nodes WHERE contains(file_path, '/')) GROUP BY name")
def arch_file_tree(g):
    return architecture.file_tree(Scoped(g)).select("name", F.array_join("children", ",").alias("children"))


@query(", both_ways AS (SELECT source AS a, target AS b FROM edges WHERE kind = 'calls' AND source <> target UNION SELECT target, source FROM edges WHERE kind = 'calls' AND source <> target), r(id, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM r JOIN both_ways e ON e.a = r.id AND r.root < e.b) SELECT id, min(root) AS cluster FROM r GROUP BY id")
def arch_clusters(g):
    return architecture.clusters(Scoped(g))


# Search ---------------------------------------------------------------------------------------------------------------

_BM25 = """WITH d AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
c AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'from')) AS f1 FROM d),
t AS (SELECT count(*) AS n, avg(dl) AS mean, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM c)
SELECT id AS doc_id, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM c, t WHERE f0 > 0 AND f1 > 0"""


@query(_BM25, graph=False)
def search_bm25(spark, sf_dir):
    return search.bm25(docs(spark, sf_dir), "doc_id", search.search_terms(F.col("text")), ["the", "from"], None).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT id, name FROM nodes WHERE list_contains(string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), 'order') AND list_contains(string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), '77')")
def search_nodes(g):
    return search.search_nodes(g, "order_77", 1_000_000).select("id", "name")


@query("SELECT id, kind FROM nodes WHERE (name = 'small ring' OR qualified_name = 'small ring') AND kind NOT IN ('file', 'import', 'export') ORDER BY id LIMIT 50")
def find_definitions(g):
    return search.find_definitions(g, "small ring").select("id", "kind")


@query("SELECT id, seq FROM nodes ORDER BY seq DESC LIMIT 50")
def search_recent(g):
    return search.search_recent(g).select("id", "seq")


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'an') OR contains(lower(qualified_name), 'an') OR contains(lower(file_path), 'an') ORDER BY name, id LIMIT 50")
def search_substring(g):
    return search.substring_search(g, "An").select("id", "name")


_SPANS = "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, string_split(text, chr(10)) AS lines FROM documents"


def _document_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Documents as files whose nodes are runs of three lines; the first run of every tenth document is called by those after it."""
    d = docs(spark, sf_dir).select("doc_id", document_path().alias("path"), "text")
    n = d.select("doc_id", "path", F.size(F.split("text", "\n")).alias("n")).select("doc_id", "path", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 3))).alias("k"))
    name = F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("k").cast("string"))
    nodes = complete(n.select(name.alias("id"), F.lit("function").alias("kind"), name.alias("name"), name.alias("qualified_name"), F.col("path").alias("file_path"), F.lit("text").alias("language"), (F.col("k") * 3 + 1).cast("int").alias("start_line"), F.least(F.col("k") * 3 + 3, F.col("n")).cast("int").alias("end_line")), schema.NODE)
    edges = complete(n.where("k = 0").select(name.alias("id"), name.alias("source"), F.concat(F.lit("chunk_"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string"), F.lit("_0")).alias("target"), F.lit("calls").alias("kind"), F.col("doc_id").alias("seq")), schema.EDGE)
    return Graph(nodes, edges), d


_HITS = f", hits AS (SELECT doc_id, file_path, i AS line, lines[i] AS t, instr(lines[i], 'that') AS a, instr(lines[i], 'from') AS b FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM ({_SPANS})) WHERE contains(lines[i], 'that') AND contains(lines[i], 'from') AND length(lines[i]) <= 4096)"


@query(f"WITH x AS (SELECT 1){_HITS} SELECT 'chunk_' || doc_id || '_' || ((line - 1) // 3) AS node_id, file_path, min(line)::BIGINT AS line, arg_min(least(a, b), line)::BIGINT AS col, count(*) AS match_count FROM hits GROUP BY 1, 2, doc_id", graph=False)
def code_search(spark, sf_dir):
    g, files = _document_graph(spark, sf_dir)
    r = search.code_search(g, files, "that from", limit=1 << 30, context=1)
    return r.select("node_id", "file_path", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "match_count")


@query(f"WITH x AS (SELECT 1){_HITS}, f AS (SELECT doc_id, file_path, min(line) AS line FROM hits GROUP BY doc_id, file_path, (line - 1) // 3) SELECT f.file_path, f.line::BIGINT AS line, array_to_string(lines[greatest(1, f.line - 2):f.line + 2], chr(10)) AS snippet, 'definition' AS hit_kind FROM f JOIN ({_SPANS}) s ON s.doc_id = f.doc_id", graph=False)
def code_search_snippets(spark, sf_dir):
    g, files = _document_graph(spark, sf_dir)
    return search.code_search(g, files, "that from", limit=1 << 30, context=2).select("file_path", F.col("line").cast("long").alias("line"), "snippet", "hit_kind")


@query(f"WITH x AS (SELECT 1){_HITS}, c AS (SELECT doc_id - doc_id % 10 AS d, count(*) AS n FROM documents GROUP BY 1) SELECT 'chunk_' || h.doc_id || '_' || ((line - 1) // 3) AS node_id, file_path, min(line)::BIGINT AS line, CASE WHEN h.doc_id % 10 = 0 AND (line - 1) // 3 = 0 THEN any_value(c.n) ELSE 0 END AS in_degree FROM hits h LEFT JOIN c ON c.d = h.doc_id GROUP BY h.doc_id, (line - 1) // 3, file_path ORDER BY in_degree DESC, file_path, line LIMIT 10", graph=False)
def code_search_top(spark, sf_dir):
    g, files = _document_graph(spark, sf_dir)
    return search.code_search(g, files, "that from").select("node_id", "file_path", F.col("line").cast("long").alias("line"), "in_degree")


@query("SELECT id AS point, arg_min(node_id, node_id) AS node_id FROM (SELECT p.id, n.id AS node_id, n.end_line - n.start_line AS span, min(n.end_line - n.start_line) OVER (PARTITION BY p.id) AS least_span FROM (SELECT id, file_path, start_line + 1 AS line FROM nodes WHERE kind = 'function') p JOIN nodes n ON n.file_path = p.file_path AND p.line BETWEEN n.start_line AND n.end_line WHERE n.kind IN ('function', 'method', 'class', 'trait', 'interface', 'struct', 'route')) WHERE span = least_span GROUP BY id")
def enclosing_node(g):
    points = g.nodes.where("kind = 'function'").select(F.col("id").alias("point"), "file_path", (F.col("start_line") + 1).alias("line"))
    return search.enclosing(points, g.nodes).where("node_id is not null").select("point", "node_id")


# Scalars --------------------------------------------------------------------------------------------------------------


@query("WITH w AS (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' '), '_') AS w FROM documents), t AS (SELECT doc_id, list_filter(string_split(lower(replace(regexp_replace(ltrim(w, '_'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), ' '), lambda x: x <> '') AS a FROM w) SELECT doc_id, array_to_string(list_filter(a, lambda x, i: i = 1 OR a[i - 1] <> x), ' ') AS tokens FROM t", graph=False)
def tokenize_identifier(spark, sf_dir):
    """Each whole text as one identifier of many words."""
    word = F.array_join(F.split(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), " "), "_")
    return docs(spark, sf_dir).select("doc_id", text.tokenize_identifier(word).alias("tokens"))


@query(f"SELECT DISTINCT file_path, {_PKG.format(p='file_path')} AS package FROM nodes")
def package_of(g):
    return g.nodes.select("file_path", paths.package_of(F.col("file_path")).alias("package")).distinct()


@query("SELECT page_id, coalesce(nullif(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(p, '/{2,}', '/', 'g'), '/'), lambda s: CASE WHEN regexp_matches(s, '^(:.+|\\{.*\\}|<.*>|\\*.*)$') THEN '*' ELSE s END), '/'), '/+$', ''), ''), '/') AS path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') || '//:id/{x}/' || page_id || '/' AS p FROM pages)", graph=False)
def normalize_http_path(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit("//:id/{x}/"), F.col("page_id").cast("string"), F.lit("/"))
    return p.select("page_id", paths.normalize_http_path(raw).alias("path"))


def _routes(spark: SparkSession, sf_dir: str, role: int) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("page_id") % 2 == role)
    first = F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "/"), 1)
    last = F.when(F.col("page_id") % 3 == 0, F.lit(":id")).otherwise((F.col("page_id") % 5).cast("string"))
    method = F.when(F.col("page_id") % 4 < 2, "GET").otherwise("post")
    return p.select(method.alias("method"), F.concat(F.lit("/"), first, F.lit("/"), last).alias("path"))


_R = "SELECT DISTINCT CASE WHEN page_id % 4 < 2 THEN 'GET' ELSE 'post' END AS m, '/' || split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) || '/' || CASE WHEN page_id % 3 = 0 THEN ':id' ELSE (page_id % 5)::VARCHAR END AS p FROM pages WHERE page_id % 2 = {r}"
_SEG = "list_transform(list_filter(string_split({p}, '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, ':') THEN '*' ELSE s END)"


@query(f"""WITH s AS (SELECT m, p, {_SEG.format(p='p')} AS a FROM ({_R.format(r=0)})), c AS (SELECT m, p, {_SEG.format(p='p')} AS b FROM ({_R.format(r=1)})),
x AS (SELECT s.m AS server_method, s.p AS server_path, c.m AS client_method, c.p AS client_path,
 CASE WHEN lower(s.m) = lower(c.m) AND a = b THEN 1.0
  WHEN lower(s.m) = lower(c.m) AND len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i] AND a[i] <> '*' AND b[i] <> '*')) = 0 THEN 0.85
  WHEN lower(s.m) = lower(c.m) AND (a[-1] = '*' OR b[-1] = '*') AND regexp_replace(array_to_string(a, '/'), '(/?\\*)+$', '') = regexp_replace(array_to_string(b, '/'), '(/?\\*)+$', '') AND regexp_replace(array_to_string(a, '/'), '(/?\\*)+$', '') <> '' THEN 0.7
  WHEN lower(s.m) <> lower(c.m) AND a = b THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM s, c)
SELECT * FROM x WHERE confidence >= 0.5""", graph=False)
def cross_service(spark, sf_dir):
    return http.cross_service(_routes(spark, sf_dir, 0), _routes(spark, sf_dir, 1))


# Similarity -----------------------------------------------------------------------------------------------------------

_SEED = [((i * 37) % 11 - 5) / 5 for i in range(64)]


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(map(str, _SEED)) + "]::DOUBLE[]), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(map(str, _SEED)) + "]::DOUBLE[]) > 0 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(map(str, _SEED)) + "]::DOUBLE[]), 9) DESC, vec_id LIMIT 20", graph=False)
def cosine_topk(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return similarity.cosine_top_k(v, _SEED, 20).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("w"))


_WORDS = "WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark) "
_PAIR = "SELECT a.item_id AS a, c.item_id AS b, "


def _pairs(spark, sf_dir):
    """Items that share a word: an inverted index finds them, no cross product."""
    w = _benchmark_words(spark, sf_dir)
    t = w.select("item_id", F.explode("w").alias("t"))
    ids = t.select(F.col("item_id").alias("a"), "t").join(t.select(F.col("item_id").alias("b"), "t"), "t").where("a < b").select("a", "b").distinct()
    return ids.join(w.select(F.col("item_id").alias("a"), F.col("w").alias("x")), "a").join(w.select(F.col("item_id").alias("b"), F.col("w").alias("y")), "b")


@query(_WORDS + _PAIR + "round(len(list_intersect(a.w, c.w)) / (len(a.w) + len(c.w) - len(list_intersect(a.w, c.w))), 6) AS score FROM b a JOIN b c ON a.item_id < c.item_id WHERE len(list_intersect(a.w, c.w)) > 0", graph=False)
def jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(vectors.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query(_WORDS + _PAIR + "round(k / sqrt((k + (len(a.w) - k) * (ln(1.5) + 1) ** 2) * (k + (len(c.w) - k) * (ln(1.5) + 1) ** 2)), 6) AS score FROM b a JOIN b c ON a.item_id < c.item_id, LATERAL (SELECT len(list_intersect(a.w, c.w)) AS k) WHERE k > 0", graph=False)
def tfidf_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(similarity.tfidf_pair(F.col("x"), F.col("y")), 6).alias("score"))


_DIFFUSE = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
e AS (SELECT a.id AS s, b.id AS t, k FROM v a, LATERAL (SELECT unnest([1, 2, 3]) AS k) JOIN v b ON b.id = a.id + k),
m AS (SELECT s AS id, i, avg(v.vec[i]) AS x FROM e JOIN v ON v.id = e.t, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
mm AS (SELECT id, list(x ORDER BY i) AS mean FROM m GROUP BY id),
d AS (SELECT v.id, CASE WHEN mean IS NULL THEN vec ELSE list_transform(range(1, 65), lambda i: 0.7 * vec[i] + 0.3 * mean[i]) END AS w FROM v LEFT JOIN mm ON mm.id = v.id)
SELECT id AS vec_id, round(w[1] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS x0, round(w[64] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS x63 FROM d"""


@query(_DIFFUSE, graph=False)
def diffuse(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    e = v.select(F.col("id").alias("source"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq")).select("source", (F.col("source") + F.col("seq")).alias("target"), "seq")
    return similarity.diffuse(v, e).select(F.col("id").alias("vec_id"), F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(F.get("vec", F.lit(63)), 6).alias("x63"))


@query(graph=False)
def minhash(spark, sf_dir):
    # Hashing is the cost, so a table of few splits is dealt to the cores first.
    d = docs(spark, sf_dir).select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    return d.select("doc_id", hashes.minhash(F.split("text", "[ \n]+")).alias("minhash"))


@query("WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::UHUGEINT) AS bytes FROM documents) SELECT doc_id, format('{:016x}', list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS hash FROM b", graph=False)
def content_hash_fnv(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", hashes.content_hash("text").alias("hash"))


@query(graph=False)
def random_index(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(F.split("text", "[ \n]+")).alias("token")).where("token <> ''").distinct()
    return words.select("token", hashes.random_index("token", F.lit(64)).alias("vec"))


@query(graph=False)
def random_index_corpus(spark, sf_dir):
    b = _benchmark_words(spark, sf_dir).select(F.col("item_id").alias("id"), F.col("w").alias("tokens"))
    return similarity.random_index_corpus(b, 64).select("token", F.round("idf", 6).alias("idf"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def semantic_edges(g):
    return similarity.related(g)[1].select("source", "target", F.round("score", 6).alias("score"))


# Construction ---------------------------------------------------------------------------------------------------------


@query(", open_calls AS (SELECT row_number() OVER (ORDER BY seq) AS i, source, target, seq FROM edges WHERE kind = 'calls' ), c AS (SELECT o.source, o.seq, n.name AS wanted, s.file_path AS sf FROM open_calls o JOIN nodes n ON n.id = o.target JOIN nodes s ON s.id = o.source), k AS (SELECT c.seq, c.source, m.id, row_number() OVER (PARTITION BY c.seq ORDER BY CASE WHEN m.file_path = c.sf THEN 0 WHEN starts_with(m.file_path, regexp_replace(c.sf, '[^/]*$', '')) THEN 1 ELSE 2 END, m.seq) AS r FROM c JOIN nodes m ON m.name = c.wanted) SELECT source, id AS target, seq FROM k WHERE r = 1")
def resolve_references(g):
    name = g.nodes.select(F.col("id").alias("target"), "name")
    open_ = g.edges.where("kind = 'calls'").join(name, "target").select("source", F.concat(F.lit("function:"), "name", F.lit(":*")).alias("target"), "line", "seq")
    # Written, as resolution reads open and other edges apart; a call's seq is its own, so it serves as id.
    open_ = complete(stored(open_).withColumns({"id": F.col("seq").cast("string"), "kind": F.lit("calls")}), schema.EDGE)
    return resolve.resolve_references(g.nodes, open_).select("source", "target", "seq")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir)
    old = d.where("doc_id % 7 <> 0").select(document_path().alias("path"), F.col("doc_id").alias("mtime"), F.md5("text").alias("content_hash"))
    new = d.where("doc_id % 11 <> 0").select(document_path().alias("path"), (F.col("doc_id") + (F.col("doc_id") % 3 == 0).cast("long")).alias("mtime"), F.md5(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return old, new


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 6 = 0 THEN 'changed' WHEN doc_id % 3 = 0 THEN 'refresh' ELSE 'skip' END AS action FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)", graph=False)
def incremental_diff(spark, sf_dir):
    return incremental.diff_files(*_snapshots(spark, sf_dir))


@query("SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS seq, count(*) AS version FROM orders GROUP BY o_custkey", graph=False)
def upsert_last_wins(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return resolve.last_wins(o, ["id"]).select("id", "seq", F.col("version").cast("long").alias("version"))


@query("SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderkey % 2, o_orderkey)) AS seq, count(*) AS version FROM orders GROUP BY o_custkey", graph=False)
def upsert_batches(spark, sf_dir):
    """Even orders first, then odd ones on top of them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    old = resolve.last_wins(o.where("seq % 2 = 0"), ["id"])
    return resolve.upsert(old, o.where("seq % 2 = 1"), ["id"]).select("id", "seq", F.col("version").cast("long").alias("version"))


@query("SELECT id, seq FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id OR e.target = n.id)")
def isolated_nodes(g):
    ends = g.edges.select(F.col("source").alias("id")).unionByName(g.edges.select(F.col("target").alias("id")))
    return g.nodes.join(ends, "id", "left_anti").select("id", "seq")


# Routes, metrics and predicates over pages and customers ----------------------------------------------------------------


def _route_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages as route nodes: even ones are served, odd ones are called; every fifth says nothing of itself."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    said = F.create_map(F.lit("http.method"), F.when(F.col("page_id") % 4 < 2, "GET").otherwise("post"), F.lit("http.path"), path, F.lit("http.framework"), F.when(F.col("page_id") % 3 == 0, "express").otherwise("gin"), F.lit("http.role"), F.when(F.col("page_id") % 2 == 0, "server").otherwise("client"))
    nodes = p.select(F.concat(F.lit("route:"), F.col("page_id").cast("string")).alias("id"), F.lit("route").alias("kind"), path.alias("name"), F.lit("src/routes.js").alias("file_path"), F.lit("javascript").alias("language"), F.col("page_id").cast("int").alias("start_line"), F.col("page_id").cast("int").alias("end_line"), F.when(F.col("page_id") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(said).alias("extra"))
    return Graph(complete(nodes, schema.NODE), spark.createDataFrame([], schema.EDGE))


_ROUTE_SQL = "SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, CASE WHEN page_id % 5 = 0 THEN '*' WHEN page_id % 4 < 2 THEN 'GET' ELSE 'post' END AS method, CASE WHEN page_id % 5 = 0 THEN 'unknown' WHEN page_id % 3 = 0 THEN 'express' ELSE 'gin' END AS framework, CASE WHEN page_id % 5 = 0 OR page_id % 2 = 0 THEN 'server' ELSE 'client' END AS role FROM pages"


@query(f"SELECT role, method, path, framework, page_id AS line FROM ({_ROUTE_SQL}) WHERE lower(method) = 'get'", graph=False)
def http_routes(spark, sf_dir):
    return http.http_routes(_route_graph(spark, sf_dir), method="get").select("role", "method", "path", "framework", F.col("start_line").cast("long").alias("line"))


@query(f"SELECT method, path, framework FROM ({_ROUTE_SQL}) WHERE role = 'client'", graph=False)
def route_records(spark, sf_dir):
    return http.route_records(_route_graph(spark, sf_dir), "client").select("method", "path", "framework")


@query(f"SELECT page_id AS line, path AS name, CASE WHEN page_id % 5 <> 0 THEN method END AS method, CASE WHEN page_id % 5 <> 0 THEN path END AS path FROM ({_ROUTE_SQL})", graph=False)
def arch_routes(spark, sf_dir):
    return architecture.routes(Scoped(_route_graph(spark, sf_dir))).select(F.col("start_line").cast("long").alias("line"), "name", "method", "path")


@query("SELECT 'function:' || c_custkey AS id, c_custkey % 10 AS cyclomatic, c_custkey % 7 AS cognitive, c_custkey % 2 = 0 AS recursion FROM customer WHERE c_custkey % 3 <> 0", graph=False)
def complexity(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    values = {"cyclomatic": (k % 10).cast("string"), "cognitive": (k % 7).cast("string"), "loop_depth": F.lit("0"), "alloc_in_loop": F.lit("false"), "linear_scan_in_loop": F.lit("true"), "recursion": (k % 2 == 0).cast("string"), "unguarded_recursion": F.when(k % 3 == 0, "maybe").otherwise("false")}
    nodes = c.select(F.concat(F.lit("function:"), k.cast("string")).alias("id"), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).alias("extra"))
    return analytics.complexity_of(nodes).select("id", F.col("cyclomatic").cast("long").alias("cyclomatic"), F.col("cognitive").cast("long").alias("cognitive"), "recursion")


@query("SELECT page_id, translate(url, '/:{}<>*? ', '_________') AS segment FROM pages", graph=False)
def sanitize_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.sanitize_id_segment(F.col("url")).alias("segment"))


@query("SELECT doc_id, CASE e WHEN 'rs' THEN 'rust' WHEN 'd.ts' THEN 'typescript' WHEN 'test.ts' THEN 'typescript' WHEN 'h' THEN 'c' END AS language, doc_id % 5 = 2 OR doc_id % 2 = 0 AS is_test, doc_id % 5 = 1 OR doc_id % 5 = 2 AS is_ts FROM (SELECT doc_id, ['rs', 'd.ts', 'test.ts', 'h', 'py'][doc_id % 5 + 1] AS e FROM documents)", graph=False)
def file_predicates(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, ("rs", "d.ts", "test.ts", "h", "py"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "tests/").otherwise("src/"), F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ends)
    d = docs(spark, sf_dir).select("doc_id", path.alias("path"))
    return d.select("doc_id", paths.language_of(F.col("path")).alias("language"), paths.is_test_file(F.col("path")).alias("is_test"), paths.has_extension(F.col("path"), ["TS"]).alias("is_ts"))


@query("SELECT n_name, lower(trim(concat('  ', n_name, '  '))) AS name, nullif(left(trim(concat('  ', repeat(n_name || ' ', n_nationkey % 20))), 120), '') AS signature FROM nation", graph=False)
def signature_lines(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.concat(F.lit("  "), F.repeat(F.concat("n_name", F.lit(" ")), F.col("n_nationkey") % 20))
    return n.select("n_name", F.lower("n_name").alias("name"), text.signature_of_line(line).alias("signature"))
