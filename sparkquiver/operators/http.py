"""HTTP routes and calls: listing, and matching of server routes with client calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.functions.paths import path_segments
from sparkquiver.functions.text import ascii_lower
from sparkquiver.graph import Graph


def route_records(graph: Graph, role: str | None = None) -> DataFrame:
    """Route nodes as records; what a node doesn't say is *, its name, unknown and server."""
    look = lambda k, other: F.coalesce(F.try_element_at("extra", F.lit(f"http.{k}")), other)
    r = graph.nodes.where("kind = 'route'").select(look("method", F.lit("*")).alias("method"), look("path", F.col("name")).alias("path"), look("framework", F.lit("unknown")).alias("framework"), look("role", F.lit("server")).alias("role"), "file_path", "start_line", "end_line", F.try_element_at("extra", F.lit("http.handler")).alias("handler_qualified_name"))
    return r if role is None else r.where(F.col("role") == role)


def http_routes(graph: Graph, framework: str | None = None, method: str | None = None) -> DataFrame:
    r = route_records(graph)
    if framework is not None:
        r = r.where(F.col("framework") == framework)
    if method is not None:
        r = r.where(F.lower("method") == method.lower())
    return r.orderBy("role", "method", "path", "file_path", "start_line")


def _wild_equal(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda t: t)


def _stem(segments: Column) -> Column:
    """The path without the wildcards at its end."""
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(segments, "/")), r"(/\*)+$", "")


def confidence(method_a: Column, a: Column, method_b: Column, b: Column) -> Column:
    """1 the same; .85 as long and alike but for wildcards; .7 alike without the wildcards at an end; .5 the same path by another
    method; else 0. a and b are segments of normalised paths."""
    same_method = ascii_lower(method_a) == ascii_lower(method_b)
    open_end = (F.element_at(F.concat(F.array(F.lit("")), a), -1) == "*") | (F.element_at(F.concat(F.array(F.lit("")), b), -1) == "*")
    glob = open_end & (_stem(a) == _stem(b)) & (_stem(a) != "")
    return F.when(same_method & (a == b), 1.0).when(same_method & (F.size(a) == F.size(b)) & _wild_equal(a, b), 0.85).when(same_method & glob, 0.7).when(~same_method & (a == b), 0.5).otherwise(0.0)


def cross_service(server: DataFrame, client: DataFrame, least: float = 0.5) -> DataFrame:
    """(server_method, server_path, client_method, client_path, confidence), best first. server, client: (method, path).

    Instead of every pair, routes meet by keys: equal paths; equal length and first segments, where either first segment may be
    a wildcard; equal paths without the wildcards at their ends. Each key is an equi-join on what a score needs.
    """
    s = server.select(F.col("method").alias("server_method"), F.col("path").alias("server_path"), path_segments(F.col("path")).alias("s")).distinct()
    c = client.select(F.col("method").alias("client_method"), F.col("path").alias("client_path"), path_segments(F.col("path")).alias("c")).distinct()

    def keys(col: Column) -> Column:
        """Keys of the score .85: length with the concrete first segment and with a wildcard."""
        first = F.coalesce(F.get(col, F.lit(0)), F.lit(""))
        n = F.size(col).cast("string")
        return F.concat_ws(":", F.lit("n"), n, first), F.concat_ws(":", F.lit("n"), n, F.lit("*")), F.concat_ws(":", F.lit("w"), n), F.concat_ws(":", F.lit("p"), _stem(col)), first

    sn, _, sw, sp, s1 = keys(F.col("s"))
    cn, _, cw, cp, c1 = keys(F.col("c"))
    left = s.withColumn("k", F.explode(F.array(sn, F.when(s1 == "*", sw).otherwise(F.concat(sw, F.lit("!"))), sp)))
    right = c.withColumn("k", F.explode(F.array_compact(F.array(cn, cp, sw_of(cw, c1, True), sw_of(cw, c1, False)))))
    score = confidence(F.col("server_method"), F.col("s"), F.col("client_method"), F.col("c"))
    pairs = left.join(right, "k").withColumn("confidence", score).where(F.col("confidence") >= max(least, 1e-9))
    return pairs.select("server_method", "server_path", "client_method", "client_path", "confidence").distinct().orderBy(F.col("confidence").desc(), "server_path", "client_path", "server_method", "client_method")


def sw_of(w: Column, first: Column, wild: bool) -> Column:
    """A client's key to servers whose first segment is a wildcard, or, if its own is, to those whose isn't."""
    return w if wild else F.when(first == "*", F.concat(w, F.lit("!")))
