"""A property graph over relational tables, the same in Spark and in SQL.

Regions, nations, suppliers, customers, parts and orders are nodes; membership, successive orders, trade between nations and
ordered parts are edges. GRAPH_SQL is the same graph as DuckDB common table expressions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver import schema
from sparkquiver.graph import Graph, complete
from sparkquiver.operators.components import ensure_checkpoint_dir

#: Places in seq of one table's rows.
SEQ_STEP = 10_000_000_000
_LANGUAGES = ("rust", "typescript", "javascript", "c", "cpp")


def _slug(c: Column) -> Column:
    return F.translate(F.lower(c), " ", "_")


def table_graph(spark: SparkSession, sf_dir: str) -> Graph:
    nodes, edges = (reduce(DataFrame.unionByName, x.values()) for x in graph_parts(spark, sf_dir))
    return Graph(nodes, edges, _files(nodes), document_coverage(spark, sf_dir))


def _files(nodes: DataFrame) -> DataFrame:
    return complete(nodes.groupBy(F.col("file_path").alias("path")).agg(F.min("language").alias("language")), schema.FILE)


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The nodes and the edges of the tables, each by kind."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("region") % 5 + 1).cast("int"))
    place = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), _slug(F.col("r_name")).alias("r"), _slug(F.col("n_name")).alias("n"))

    def node(df: DataFrame, kind: str, key: str, name: Column, path: Column, base: int, exported: Column, public: Column, extra: Column | None = None) -> DataFrame:
        k = F.col(key).cast("bigint")
        start = (k % 1000 + 1).cast("int")
        out = df.select(
            F.concat(F.lit(f"{kind}:"), k.cast("string")).alias("id"),
            F.lit(kind).alias("kind"),
            name.alias("name"),
            F.concat(F.lit(f"{kind}::"), name).alias("qualified_name"),
            path.alias("file_path"),
            language.alias("language"),
            start.alias("start_line"),
            (start + k % 7).cast("int").alias("end_line"),
            F.concat(F.lit("fn "), name, F.lit("()")).alias("signature"),
            F.when(public, F.lit("pub")).alias("visibility"),
            F.coalesce(exported, F.lit(False)).alias("is_exported"),
            (k % 3 == 0).alias("is_async"),
            (extra if extra is not None else F.create_map().cast("map<string,string>")).alias("extra"),
            (F.lit(base).cast("bigint") * SEQ_STEP + k).alias("seq"),
        )
        return complete(out, schema.NODE)

    no = F.lit(False)
    region = node(t["region"].withColumn("region", F.col("r_regionkey")), "namespace", "r_regionkey", F.col("r_name"), F.concat(_slug(F.col("r_name")), F.lit("/lib.rs")), 0, no, no)
    at = lambda df, key: df.join(place, F.col(key) == F.col("nation"))
    nation = node(at(t["nation"], "n_nationkey"), "module", "n_nationkey", F.col("n_name"), F.concat_ws("/", "r", "n", F.lit("mod.rs")), 1, no, no)
    supplier = node(at(t["supplier"], "s_nationkey"), "struct", "s_suppkey", F.col("s_name"), F.concat_ws("/", "r", "n", F.lit("suppliers.rs")), 2, F.col("s_acctbal") > 5000, F.col("s_acctbal") > 8000)
    segment = F.lower(F.coalesce(F.col("c_mktsegment"), F.lit("x")))
    inside = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("bin/"), segment)).otherwise(segment)
    extra = F.create_map(F.lit("segment"), F.coalesce("c_mktsegment", F.lit("")), F.lit("cyclomatic"), (F.col("c_custkey") % 10).cast("string"))
    customer = node(at(t["customer"], "c_nationkey"), "function", "c_custkey", F.col("c_name"), F.concat_ws("/", "r", "n", F.concat(inside, F.lit(".rs"))), 3, F.col("c_acctbal") > 9000, F.col("c_acctbal") > 9500, extra)
    part = node(t["part"].withColumn("region", F.col("p_partkey") % 5), "class", "p_partkey", F.col("p_name"), F.concat(F.lit("parts/"), F.translate(F.lower("p_brand"), " #", "__"), F.lit(".rs")), 4, F.col("p_size") > 40, no)
    order = node(t["orders"].withColumn("region", F.col("o_orderkey") % 5), "method", "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.concat(F.lit("orders/"), F.lower("o_orderstatus"), F.lit("/batch.rs")), 5, no, no)
    nodes = {"namespace": region, "module": nation, "struct": supplier, "function": customer, "class": part, "method": order}

    def edge(df: DataFrame, kind: str, source: Column, target: Column, line: Column, base: int, key: Column) -> DataFrame:
        out = df.select(_edge_id(F.lit(kind), key, target).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), (F.lit(base).cast("bigint") * SEQ_STEP + key).alias("seq"))
        return complete(out, schema.EDGE)

    of = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    o1 = t["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"))
    o2 = t["orders"].select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").alias("b"))
    calls = edge(o1.join(o2, "k"), "calls", of("function", "a"), of("function", "b"), F.col("k") % 1000 + 1, 1, F.col("k"))
    line = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey")
    # Orders take their customer's nation first, so that the lines, which are most, are shuffled once; they stream past a hash of the
    # orders of a partition, which is small and even as orders have a key of their own, instead of being sorted.
    placed = t["orders"].select("o_orderkey", "o_custkey").join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    trade = line.join(placed.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    imports = edge(trade, "imports", of("module", "c_nationkey"), of("module", "s_nationkey"), F.lit(1), 2, F.col("l_orderkey"))
    references = edge(line, "references", of("method", "l_orderkey"), of("class", "l_partkey"), F.lit(2), 3, F.col("l_orderkey"))
    contains = edge(t["nation"], "contains", of("namespace", "n_regionkey"), of("module", "n_nationkey"), F.lit(0), 4, F.col("n_nationkey").cast("bigint"))
    contains = contains.unionByName(edge(t["customer"], "contains", of("module", "c_nationkey"), of("function", "c_custkey"), F.lit(0), 5, F.col("c_custkey")))
    contains = contains.unionByName(edge(t["supplier"], "contains", of("module", "s_nationkey"), of("struct", "s_suppkey"), F.lit(0), 6, F.col("s_suppkey")))
    return nodes, {"calls": calls, "imports": imports, "references": references, "contains": contains}


def _edge_id(kind: Column, key: Column, target: Column) -> Column:
    return F.concat(kind, F.lit(":"), key.cast("string"), F.lit(":"), target)


#: Where this process has written a graph: (application, folder of tables) to folder.
_WRITTEN: dict[tuple[str, str], str] = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """table_graph, written once an application to the checkpoint folder, nodes and edges by kind, and read from there: a query
    scans the kinds and columns that it needs instead of joining the tables again.

    Each kind is a write of its own into its partition's folder: a write that splits rows by kind sorts all that a task has first.
    An edge's id, which its other columns give, is made on reading."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        ensure_checkpoint_dir(spark)
        at = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/graph-{uuid.uuid4().hex}"
        nodes, edges = graph_parts(spark, sf_dir)
        for kind, df in nodes.items():
            df.drop("kind").write.parquet(f"{at}/nodes/kind={kind}")
        for kind, df in edges.items():
            df.drop("kind", "id").write.parquet(f"{at}/edges/kind={kind}")
        _files(spark.read.schema(schema.NODE).parquet(f"{at}/nodes")).write.parquet(f"{at}/files")
        _WRITTEN[key] = at
    at = _WRITTEN[key]
    nodes, edges, files = (complete(spark.read.schema(ddl).parquet(f"{at}/{n}"), ddl) for n, ddl in (("nodes", schema.NODE), ("edges", schema.EDGE), ("files", schema.FILE)))
    edges = edges.withColumn("id", _edge_id(F.col("kind"), F.col("seq") % SEQ_STEP, F.col("target")))
    return Graph(nodes, edges, files, document_coverage(spark, sf_dir))


def document_coverage(spark: SparkSession, sf_dir: str, most: int = 8000) -> DataFrame:
    """Documents as files: those over a size are skipped."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    over = F.col("n_chars") > most
    out = d.select(document_path().alias("path"), F.col("lang").alias("language"), F.when(over, "skipped").otherwise("indexed").alias("status"), F.when(over, F.lit("file too large")).alias("reason"), F.col("n_chars").cast("bigint").alias("size_bytes"), F.lit(0).cast("bigint").alias("indexed_at"))
    return complete(out, schema.COVERAGE)


def document_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


GRAPH_SQL = """
WITH RECURSIVE place AS (
  SELECT n_nationkey AS nation, n_regionkey AS region, replace(lower(r_name), ' ', '_') AS r, replace(lower(n_name), ' ', '_') AS n
  FROM nation JOIN region ON n_regionkey = r_regionkey),
raw_nodes AS (
  SELECT 'namespace' AS kind, r_regionkey::BIGINT AS k, r_name AS name, replace(lower(r_name), ' ', '_') || '/lib.rs' AS file_path, r_regionkey::BIGINT AS region, false AS is_exported, false AS public, 0 AS base, NULL::VARCHAR AS segment FROM region
  UNION ALL SELECT 'module', n_nationkey, n_name, r || '/' || n || '/mod.rs', region, false, false, 1, NULL FROM nation JOIN place ON n_nationkey = nation
  UNION ALL SELECT 'struct', s_suppkey, s_name, r || '/' || n || '/suppliers.rs', region, s_acctbal > 5000, s_acctbal > 8000, 2, NULL FROM supplier JOIN place ON s_nationkey = nation
  UNION ALL SELECT 'function', c_custkey, c_name, r || '/' || n || '/' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bin/' ELSE '' END || lower(coalesce(c_mktsegment, 'x')) || '.rs', region, c_acctbal > 9000, c_acctbal > 9500, 3, c_mktsegment FROM customer JOIN place ON c_nationkey = nation
  UNION ALL SELECT 'class', p_partkey, p_name, 'parts/' || replace(replace(lower(p_brand), ' ', '_'), '#', '_') || '.rs', p_partkey % 5, p_size > 40, false, 4, NULL FROM part
  UNION ALL SELECT 'method', o_orderkey, 'order_' || o_orderkey, 'orders/' || lower(o_orderstatus) || '/batch.rs', o_orderkey % 5, false, false, 5, NULL FROM orders),
nodes AS MATERIALIZED (
  SELECT kind || ':' || k AS id, kind, name, kind || '::' || name AS qualified_name, file_path, ['rust','typescript','javascript','c','cpp'][(region % 5 + 1)::INT] AS language,
    (k % 1000 + 1)::INT AS start_line, (k % 1000 + 1 + k % 7)::INT AS end_line, 'fn ' || name || '()' AS signature, CASE WHEN public THEN 'pub' END AS visibility,
    coalesce(is_exported, false) AS is_exported, k % 3 = 0 AS is_async, segment, CASE WHEN kind = 'function' THEN (k % 10)::VARCHAR END AS cyclomatic, base * 10000000000 + k AS seq
  FROM raw_nodes),
edges AS MATERIALIZED (
  SELECT 'function:' || a.o_custkey AS source, 'function:' || b.o_custkey AS target, 'calls' AS kind, (a.o_orderkey % 1000 + 1)::INT AS line, 10000000000 + a.o_orderkey AS seq FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  UNION ALL SELECT 'module:' || c_nationkey, 'module:' || s_nationkey, 'imports', 1, 20000000000 + l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'method:' || l_orderkey, 'class:' || l_partkey, 'references', 2, 30000000000 + l_orderkey FROM lineitem
  UNION ALL SELECT 'namespace:' || n_regionkey, 'module:' || n_nationkey, 'contains', 0, 40000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'module:' || c_nationkey, 'function:' || c_custkey, 'contains', 0, 50000000000 + c_custkey FROM customer
  UNION ALL SELECT 'module:' || s_nationkey, 'struct:' || s_suppkey, 'contains', 0, 60000000000 + s_suppkey FROM supplier)
"""
