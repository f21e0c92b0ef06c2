"""Cypher to DataFrame plans.

Every pattern variable is one struct column of node fields, so that Catalyst prunes fields and pushes filters on them down to the
scan. mode "strict" keeps the language's own comparison rules: a pair of incompatible types compares as equal, and null fails
only = and !=. mode "sane" has SQL's three-valued logic, honours DISTINCT and groups by the other items of a COUNT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.graph import Graph
from sparkquiver.operators.components import cut, if_few
from sparkquiver.plans.ast import Clause, Item, Pattern, Predicate, Query
from sparkquiver.plans.parser import parse_cypher
from sparkquiver.schema import ParseError

STRINGS = ("id", "name", "qualified_name", "file_path", "kind", "language")
FLAGS = ("is_exported", "is_async")
NUMBERS = ("start_line", "end_line")
#: Levels of a variable-length pattern between two checkpoints.
CUT_EVERY = 4
#: Seeds of a variable-length pattern to a partition, and nodes in one of the lists that its last step goes by.
SEEDS_EACH, LIST = 4096, 1024


def run_cypher(graph: Graph, text: str, mode: str = "strict") -> DataFrame:
    return compile_query(graph, parse_cypher(text), mode)


def compile_query(graph: Graph, query: Query, mode: str = "strict") -> DataFrame:
    left = _core(graph, query, mode)
    if query.union is None:
        return left
    right = _core(graph, query.union, mode)
    if len(left.columns) != len(right.columns):
        raise ParseError("both sides of a UNION return the same number of columns")
    if query.union_all:
        return left.union(right)
    if mode == "sane":
        return left.union(right).distinct()
    # The left rows stay as they are; a right row comes if neither side had it, and rows of other column names are never equal.
    right = right.distinct()
    if left.columns != right.columns:
        return left.union(right)
    l, r = left.alias("l"), right.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in left.columns])
    return left.union(r.join(l, same, "left_anti"))


def truncated(graph: Graph, query: Query, result: DataFrame) -> bool:
    """Whether the left side's LIMIT may have cut rows."""
    return query.limit is not None and result.limit(query.limit).count() >= query.limit


def _needs(query: Query) -> set[str]:
    """Node fields that the query can reach besides the id."""
    out = {"id", "seq"}
    for c in (query.match, *query.optional):
        if c.where:
            out |= _field_of(c.where.prop)
    for i in query.items:
        if i.kind == "prop":
            out |= _field_of(i.prop)
        elif i.kind == "var":
            out |= set(STRINGS + FLAGS + NUMBERS)
    if query.order and query.order.prop:
        out |= _field_of(query.order.prop)
    return out


def _field_of(prop: str) -> set[str]:
    return {prop} if prop in STRINGS + FLAGS + NUMBERS else {"extra"}


def _scan(graph: Graph, label: str | None, fields: set[str], var: str) -> DataFrame:
    """One struct column named by the variable."""
    nodes = graph.nodes
    if label is not None:
        nodes = nodes.where(F.col("kind") == label.lower())
    return nodes.select(F.struct(*[F.col(c) for c in nodes.columns if c in fields]).alias(var))


def _only_id(query: Query, var: str) -> bool:
    """Whether the query reads nothing of a variable but its id."""
    props = [c.where.prop for c in (query.match, *query.optional) if c.where and c.where.var == var]
    props += [i.prop if i.kind == "prop" else "" for i in query.items if i.kind in ("prop", "var") and i.var == var]
    return not (query.order and query.order.prop) and set(props) <= {"id"}


def _pattern(graph: Graph, p: Pattern, fields: set[str], only_id: bool = False) -> DataFrame:
    start = _scan(graph, p.start.label, fields, p.start.var)
    if p.edge is None:
        return start
    # A variable that stands at both ends is bound twice, and lookups find the first: no self-loop test.
    twice = p.start.var == p.end.var
    name = "\0end" if twice else p.end.var
    end = _scan(graph, p.end.label, fields, name)
    edges = graph.edges
    if p.edge.kind is not None:
        edges = edges.where(F.col("kind") == p.edge.kind.lower())
    if p.edge.hops is None:
        edges = edges.select("source", "target")
        # Few nodes can have very many of the edges, which would meet in as few tasks if they were shuffled.
        start, end = (x if n.label is None else if_few(x) for x, n in ((start, p.start), (end, p.end)))
    else:
        ids = end.select(F.col(f"`{name}`")["id"].alias("id"))
        edges = _walks(start.select(F.col(p.start.var)["id"].alias("seed")), edges.where(F.length("kind") > 0).select("source", "target"), *p.edge.hops, ids)
        # The pairs lie by source, so the start is joined where they are; an end of which only the id is read needs no join.
        start = start.hint("shuffle_hash")
        if (only_id or twice) and ids.groupBy("id").count().where("count > 1").isEmpty():
            end = None
    out = start.join(edges, F.col(p.start.var)["id"] == F.col("source"))
    if end is None:
        return out.drop("source", "target") if twice else out.withColumn(name, F.struct(F.col("target").alias("id"))).drop("source", "target")
    out = out.join(end, F.col("target") == F.col(f"`{name}`")["id"]).drop("source", "target")
    return out.drop(name) if twice else out


def _walks(seeds: DataFrame, edges: DataFrame, low: int, high: int, ends: DataFrame) -> DataFrame:
    """(source, target) for targets among ends (id) at the end of some walk of low to high edges, partitioned by source: each level
    is one join and one distinct, so the number of walks doesn't matter.

    The last step, which makes most pairs, moves a pair of the level before it with the list of the nodes that come next, so that
    only lists are shuffled, once; pairs are told apart where their source lies."""
    ends = ends.where("id is not null").distinct()
    level = seeds.where("seed is not null").select(F.col("seed").alias("source"), F.col("seed").alias("target")).distinct()
    among = lambda df, c: df.join(ends.select(F.col("id").alias(c)), c, "left_semi")
    if high == 0:
        return among(level, "target").select("source", "target")
    parts = max(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seeds.count() // SEEDS_EACH))
    step = edges.select(F.col("source").alias("target"), F.col("target").alias("next"))
    found = [among(level, "target")] if low == 0 and high > 1 else []
    for depth in range(1, high):
        level = level.join(step.distinct(), "target").select("source", F.col("next").alias("target")).repartition(parts, "target").distinct()
        if depth % CUT_EVERY == 0:
            level = cut(level)
        if low <= depth < high - 1:
            found.append(among(level, "target"))
    last = among(step, "next").select("target", "next")
    if low < high:  # the level before the last counts too: a node comes after itself
        last = last.union(ends.select("id", F.col("id").alias("next")))
    last = last.distinct().withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy("next")))
    lists = last.groupBy("target", F.floor((F.col("at") - 1) / LIST).alias("at")).agg(F.collect_list("next").alias("next"))
    rows = [level.join(lists, "target").select("source", "next"), *[x.select("source", F.array("target").alias("next")) for x in found]]
    moved = reduce(DataFrame.union, rows).repartition(parts, "source")
    return moved.select("source", F.explode("next").alias("target")).distinct()


def _prop(var: str, prop: str, bound: set[str]) -> tuple[Column, str]:
    """(value, type) of a property; any other name is looked up in extra, as a string."""
    if var not in bound:
        return F.lit(None).cast("string"), "null"
    c = F.col(f"`{var}`")
    if prop in STRINGS:
        return c[prop], "string"
    if prop in FLAGS:
        return c[prop], "bool"
    if prop in NUMBERS:
        return c[prop].cast("bigint"), "number"
    return F.try_element_at(c["extra"], F.lit(prop)), "string"


def _type_of(value: object) -> str:
    if value is None:
        return "null"
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def condition(p: Predicate, bound: set[str], mode: str) -> Column:
    """A filter's condition, where null keeps no row, as bare as a scan can take it."""
    value, kind = _prop(p.var, p.prop, bound)
    sane = mode == "sane"
    yes, no = F.lit(True), F.lit(False)
    if p.op in ("STARTS_WITH", "CONTAINS"):
        if kind != "string" or not isinstance(p.value, str):
            return no
        return value.startswith(p.value) if p.op == "STARTS_WITH" else value.contains(p.value)
    if p.op == "IN":
        same = [v for v in p.value if v is not None and _type_of(v) == kind]
        return value.isin(*same) if same else no
    literal = _type_of(p.value)
    if literal == kind and kind != "null":
        v = F.lit(p.value)
        hit = {"=": value == v, "!=": value != v, "<": value < v, "<=": value <= v, ">": value > v, ">=": value >= v}[p.op]
        return hit if sane or p.op in ("=", "!=", "<", ">") else hit | value.isNull()
    if sane:
        return no
    if p.op in ("<=", ">="):
        return yes
    if p.op in ("<", ">", "!="):
        return no
    # "=": true for a present value of another type, false for null on either side.
    return no if literal == "null" or kind == "null" else value.isNotNull()


def _clause(graph: Graph, c: Clause, query: Query, mode: str) -> DataFrame:
    end = c.pattern.end
    df = _pattern(graph, c.pattern, _needs(query), end is not None and _only_id(query, end.var))
    return df.where(condition(c.where, set(c.pattern.variables), mode)) if c.where else df


def _core(graph: Graph, q: Query, mode: str) -> DataFrame:
    if len(q.optional) > 1:
        raise ParseError("only one OPTIONAL MATCH is supported")
    df = _clause(graph, q.match, q, mode)
    bound = q.match.pattern.variables
    for c in q.optional:
        other = _clause(graph, c, q, mode)
        shared = [v for v in c.pattern.variables if v in bound]
        new = [v for v in c.pattern.variables if v not in bound]
        other = other.select(*[F.col(f"`{v}`")["id"].alias(f"\0{v}") for v in shared], *[F.col(f"`{v}`") for v in new])
        on = reduce(lambda a, b: a & b, [F.col(f"`{v}`")["id"] == F.col(f"`\0{v}`") for v in shared], F.lit(True))
        df = df.join(other, on, "left").drop(*[f"\0{v}" for v in shared])
        bound = bound + new
    names = set(bound)
    if q.order and q.order.prop and q.order.var in names:
        key, _ = _prop(q.order.var, q.order.prop, names)
        ties = [F.col(f"`{v}`")["seq"].asc_nulls_last() for v in bound]
        df = df.orderBy(key.desc_nulls_last() if q.order.descending else key.asc_nulls_last(), *ties)
    if q.limit is not None:
        df = df.limit(q.limit)
    if len(q.items) == 1 and q.items[0].kind == "count_star":
        return df.agg(F.count(F.lit(1)).alias(q.items[0].name))
    if mode == "sane" and any(i.kind.startswith("count") for i in q.items):
        return _grouped(df, q, names)
    out = df.select(*[_item(i, q.match.pattern, names) for i in q.items])
    return out.distinct() if q.distinct and mode == "sane" else out


def _grouped(df: DataFrame, q: Query, names: set[str]) -> DataFrame:
    keys = [_item(i, q.match.pattern, names) for i in q.items if not i.kind.startswith("count")]
    counts = [F.count(F.lit(1) if i.kind == "count_star" else F.col(f"`{i.var}`")["id"]).alias(i.name) for i in q.items if i.kind.startswith("count")]
    return df.groupBy(*keys).agg(*counts).select(*[F.col(f"`{i.name}`") for i in q.items])


def _item(i: Item, first: Pattern, names: set[str]) -> Column:
    if i.kind == "count_star":
        return F.lit(1).cast("bigint").alias(i.name)
    if i.kind == "count":
        twice = first.end is not None and first.start.var == first.end.var == i.var
        return F.lit(2 if twice else 1).cast("bigint").alias(i.name)
    if i.kind == "prop":
        return _prop(i.var, i.prop, names)[0].alias(i.name)
    if i.var not in names:
        return F.lit(None).cast("string").alias(i.name)
    c = F.col(f"`{i.var}`")
    whole = F.struct(*[c[f].alias(f) for f in STRINGS + FLAGS + NUMBERS])
    return F.when(c.isNotNull(), whole).alias(i.name)
