"""Syntax tree of the Cypher subset."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NodePattern:
    var: str
    label: str | None = None


@dataclass(frozen=True)
class EdgePattern:
    var: str | None = None
    kind: str | None = None
    hops: tuple[int, int] | None = None  # None: one edge


@dataclass(frozen=True)
class Pattern:
    start: NodePattern
    edge: EdgePattern | None = None
    end: NodePattern | None = None

    @property
    def variables(self) -> list[str]:
        names = [self.start.var] + ([self.end.var] if self.end else [])
        return list(dict.fromkeys(names))


#: A literal is a Python value: str, bool, int, float, None, or a tuple of them for IN.
@dataclass(frozen=True)
class Predicate:
    var: str
    prop: str
    op: str  # = != < <= > >= STARTS_WITH CONTAINS IN
    value: object


@dataclass(frozen=True)
class Clause:
    pattern: Pattern
    where: Predicate | None = None


@dataclass(frozen=True)
class Item:
    kind: str  # var, prop, count or count_star
    var: str | None = None
    prop: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        return {"var": f"{self.var}", "prop": f"{self.var}.{self.prop}", "count": f"count({self.var})", "count_star": "count(*)"}[self.kind]


@dataclass(frozen=True)
class Order:
    var: str
    prop: str | None
    descending: bool = False


@dataclass(frozen=True)
class Query:
    match: Clause
    optional: tuple[Clause, ...] = ()
    distinct: bool = False
    items: tuple[Item, ...] = field(default_factory=tuple)
    order: Order | None = None
    limit: int | None = None
    union: "Query | None" = None
    union_all: bool = False
