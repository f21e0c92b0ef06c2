"""Search: BM25 over identifier tokens, definitions, recent nodes and code search by enclosing node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.functions.paths import has_extension, is_test_file
from sparkquiver.functions.text import search_terms, tokenize_for_search
from sparkquiver.graph import Graph
from sparkquiver.operators.components import FEW, cut, if_few
from sparkquiver.schema import NOT_DEFINITIONS, SPAN_KINDS, InvalidRequest

K1, B = 1.2, 0.75
MAX_LINE, MAX_CONTEXT = 4096, 50


def bm25(docs: DataFrame, id_col: str, terms: Column, query: list[str], limit: int | None) -> DataFrame:
    """(id, score) of the documents that hold every query term, best first; ties by id.

    Texts are read once: a row's length and term counts are written, then a pass over those counts documents, their mean length
    and each term's documents, and a second scores.
    """
    query = list(dict.fromkeys(query))
    d = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).select("id", F.size("terms").alias("length"), *[(F.size("terms") - F.size(F.array_remove("terms", t))).alias(f"tf{i}") for i, t in enumerate(query)])
    d = cut(d)
    total = d.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    hits = d.where(" and ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(total), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = hits.select("id", score.alias("score")).orderBy(F.round(F.col("score"), 9).desc(), "id")
    return out if limit is None else out.limit(limit)


def query_terms(spark, text: str) -> list[str]:
    """A query's terms, by the expressions that make the index's."""
    body = tokenize_for_search(*[F.lit(t) for t in text.split()]) if text.split() else F.lit("")
    return list(spark.range(1).select(search_terms(body).alias("t")).first()["t"])


def node_terms() -> Column:
    return search_terms(tokenize_for_search(F.col("name"), F.col("qualified_name"), F.col("signature")))


def index_nodes(nodes: DataFrame) -> DataFrame:
    """(term, id, tf, length): the search index of nodes; a node without terms has a row with a null term."""
    t = nodes.select("id", node_terms().alias("t")).select("id", F.size("t").alias("length"), F.explode_outer("t").alias("term"))
    return t.groupBy("term", "id", "length").agg(F.count("term").cast("int").alias("tf")).select("term", "id", "tf", "length")


def updated_index(index: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The index of nodes `new`, from that of nodes `old`: only nodes that came or changed are read for terms."""
    said = lambda d: d.select("id", F.struct("name", "qualified_name", "signature").alias("said"))
    same = said(old).intersect(said(new)).select("id")
    return index.join(same, "id", "left_semi").select(*index.columns).unionByName(index_nodes(new.join(same, "id", "left_anti")))


def bm25_index(index: DataFrame, query: list[str], limit: int | None) -> DataFrame:
    """bm25 by an index: the postings of the query's terms are read, and one pass over lengths counts the nodes."""
    query = list(dict.fromkeys(query))
    total = index.groupBy("id").agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hit = index.where(F.col("term").isin(*query))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = hit.join(F.broadcast(df), "term").join(F.broadcast(total), F.lit(True))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = weighted.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms")).where(F.col("terms") == len(query))
    out = out.select("id", "score").orderBy(F.round(F.col("score"), 9).desc(), "id")
    return out if limit is None else out.limit(limit)


def search_nodes(graph: Graph, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose name, qualified name or signature hold all terms of the query; the newest nodes where it has none. A graph with an
    index is searched by it."""
    terms = query_terms(graph.spark, text)
    if not terms:
        return search_recent(graph, limit)
    found = bm25(graph.nodes, "id", node_terms(), terms, limit) if graph.postings is None else bm25_index(graph.postings, terms, limit)
    return graph.nodes.join(found, "id").orderBy(F.round("score", 9).desc(), "id")


def search_recent(graph: Graph, limit: int = 50) -> DataFrame:
    return graph.nodes.orderBy(F.col("seq").desc()).limit(limit)


def substring_search(graph: Graph, text: str, limit: int = 50) -> DataFrame:
    low = text.lower()
    hit = F.lower("name").contains(low) | F.lower("qualified_name").contains(low) | F.lower("file_path").contains(low)
    return graph.nodes.where(hit).orderBy("name", "id").limit(limit)


def find_definitions(graph: Graph, name: str, limit: int = 50) -> DataFrame:
    named = (F.col("name") == name) | (F.col("qualified_name") == name)
    return graph.nodes.where(named & ~F.col("kind").isin(*NOT_DEFINITIONS)).orderBy("id").limit(limit)


def in_degree(graph: Graph) -> DataFrame:
    return graph.edges.where("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def enclosing(points: DataFrame, spans: DataFrame, bin_lines: int = 256) -> DataFrame:
    """points (file_path, line, ...) with the smallest span around each, or nulls: node_id, node_kind, node_name, node_start.

    A range join made an equi-join: spans are put in every bin of lines that they touch, points in theirs, so a file of any
    size splits into many keys. Of equal spans the smaller id wins. Few files are sent to the spans, so that those of others aren't
    shuffled.
    """
    files = if_few(points.select("file_path").distinct())
    s = spans.join(files, "file_path", "left_semi").where(F.col("kind").isin(*SPAN_KINDS)).select("file_path", F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), F.col("start_line").alias("node_start"), F.col("end_line").alias("_end"))
    s = s.withColumn("_bin", F.explode(F.sequence((F.col("node_start") / bin_lines).cast("int"), F.greatest(F.col("node_start"), F.col("_end")).cast("double").__truediv__(bin_lines).cast("int"))))
    p = points.withColumn("_bin", (F.col("line") / bin_lines).cast("int")).withColumn("_p", F.struct("file_path", "line"))
    lines = p.select("file_path", "line", "_bin").distinct()
    hit = lines.join(s, ["file_path", "_bin"]).where("line between node_start and _end")
    best = hit.groupBy("file_path", "line").agg(F.min(F.struct((F.col("_end") - F.col("node_start")).alias("span"), "node_id", "node_kind", "node_name", "node_start")).alias("b"))
    return points.join(best.select("file_path", "line", "b.node_id", "b.node_kind", "b.node_name", "b.node_start"), ["file_path", "line"], "left")


def first_rows(ordered: DataFrame, limit: int) -> DataFrame:
    """The first rows of an ordered table, in order, where they may be very many: no task takes more than its own part of them."""
    rows = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    over, before = F.lit(False), 0
    for r in sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if limit < before + r["n"]:
            over = (part > r["p"]) | ((part == r["p"]) & (at >= limit - before))
            break
        before += r["n"]
    return rows.where(~over).drop("_at")


def code_search(graph: Graph, files: DataFrame, pattern: str, limit: int = 10, context: int = 3, extensions: list[str] | None = None, path_regex: str | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Lines that hold every word of the pattern, as it is, grouped by enclosing node and file, best first.

    files: (path, text). Test files and lines over MAX_LINE characters are left out. A group has its first hit's line, column
    and snippet, the number of hits and whether the node encloses a definition; groups are ordered by that, calls to the node,
    path and line.
    """
    if limit < 1 or not 0 <= context <= MAX_CONTEXT:
        raise InvalidRequest(f"limit must be at least 1 and context at most {MAX_CONTEXT}")
    needles = pattern.split()
    f = files.select(F.col(path_col).alias("file_path"), F.col(text_col).alias("text")).where(~is_test_file(F.col("file_path")))
    if extensions:
        f = f.where(has_extension(F.col("file_path"), extensions))
    if path_regex:
        f = f.where(F.col("file_path").rlike(f"^(?:{path_regex})"))
    for n in needles:
        f = f.where(F.col("text").contains(n))
    if not needles:
        f = f.where("false")
    hit = F.lit(True)
    lines = f.select("file_path", F.split("text", "\n").alias("lines")).select("file_path", "lines", F.posexplode("lines").alias("at", "text"))
    for n in needles:
        hit = hit & F.col("text").contains(n)
    lines = lines.where(hit & (F.length("text") <= MAX_LINE)).select("file_path", (F.col("at") + 1).alias("line"), F.least(*[F.instr("text", n) for n in needles], F.lit(1 << 30)).alias("col") if needles else F.lit(1).alias("col"), F.array_join(F.slice("lines", F.greatest(F.col("at") + 1 - context, F.lit(1)), F.col("at") + 1 + context - F.greatest(F.col("at") + 1 - context, F.lit(1)) + 1), "\n").alias("snippet"))
    found = enclosing(cut(lines), graph.nodes)
    groups = found.groupBy("node_id", "file_path").agg(F.count(F.lit(1)).alias("match_count"), F.min(F.struct("line", "col", "snippet", "node_kind", "node_name")).alias("first"))
    groups = groups.join(in_degree(graph).withColumnRenamed("id", "node_id"), "node_id", "left")
    out = groups.select("node_id", "first.node_name", "file_path", "first.line", "first.col", "first.snippet", "match_count", F.when(F.col("node_id").isNotNull(), "definition").otherwise("usage").alias("hit_kind"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))
    out = out.orderBy(F.when(F.col("hit_kind") == "definition", 0).otherwise(1), F.col("in_degree").desc(), "file_path", "line", "node_id")
    return out.limit(limit) if limit <= FEW else first_rows(out, limit)
