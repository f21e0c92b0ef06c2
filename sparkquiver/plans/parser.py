"""Recursive-descent parser of the Cypher subset."""

from __future__ import annotations

from sparkquiver.plans.ast import Clause, EdgePattern, Item, NodePattern, Order, Pattern, Predicate, Query
from sparkquiver.plans.lexer import Token, tokenize
from sparkquiver.schema import ParseError

_COMPARE = ("=", "!=", "<", "<=", ">", ">=")


def parse_cypher(text: str) -> Query:
    p = _Parser(tokenize(text))
    query = p.query()
    if p.peek() is not None:
        raise ParseError(f"unexpected trailing token {p.peek()}")
    return query


class _Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> Token | None:
        t = self.peek()
        self.at += 1
        return t

    def sees(self, *values: str, kind: str | None = None) -> bool:
        t = self.peek()
        return t is not None and t.kind in ((kind,) if kind else ("keyword", "sign")) and t.value in values

    def take(self, *values: str) -> bool:
        if self.sees(*values):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            t = self.peek()
            raise ParseError(f"expected '{value}' but found {t}" if t else f"expected '{value}' but reached end of input")

    def ident(self, what: str) -> str:
        t = self.next()
        if t is None:
            raise ParseError(f"expected {what}, found EOF")
        if t.kind != "ident":
            raise ParseError(f"expected {what}, found {t}")
        return str(t.value)

    def query(self) -> Query:
        if self.sees("OPTIONAL"):
            raise ParseError("OPTIONAL MATCH must follow a MATCH in the same query")
        if self.sees("UNION"):
            raise ParseError("UNION must follow a complete query")
        for word in ("UNWIND", "WITH"):
            if self.sees(word):
                raise ParseError(f"{word} not supported in v1")
        left = self.core()
        if self.take("UNION"):
            everything = self.take("ALL")
            right = self.core()
            if self.sees("UNION"):
                raise ParseError("UNION chains longer than 2 are not supported in v1")
            left = Query(left.match, left.optional, left.distinct, left.items, left.order, left.limit, right, everything)
        return left

    def core(self) -> Query:
        self.expect("MATCH")
        match = self.clause()
        optional = []
        while self.sees("OPTIONAL"):
            self.next()
            self.expect("MATCH")
            optional.append(self.clause())
        if self.sees("MATCH"):
            raise ParseError("only one MATCH is supported, and it comes before any OPTIONAL MATCH")
        self.expect("RETURN")
        distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        order = self.order() if self.sees("ORDER") else None
        return Query(match, tuple(optional), distinct, tuple(items), order, self.limit())

    def clause(self) -> Clause:
        pattern = self.pattern()
        return Clause(pattern, self.predicate() if self.take("WHERE") else None)

    def pattern(self) -> Pattern:
        start = self.node()
        if not self.take("-"):
            return Pattern(start)
        self.expect("[")
        var = kind = hops = None
        t = self.peek()
        if t is not None and t.kind == "ident":
            var = str(self.next().value)
        if self.take(":"):
            kind = self.ident("edge kind identifier")
        if self.take("*"):
            low = self.bound("min hops")
            self.expect("..")
            high = self.bound("max hops")
            if low > high:
                raise ParseError(f"min hops {low} is above max hops {high}")
            hops = (low, high)
        self.expect("]")
        self.expect("->")
        return Pattern(start, EdgePattern(var, kind, hops), self.node())

    def bound(self, what: str) -> int:
        t = self.next()
        if t is None or t.kind != "int":
            raise ParseError(f"expected {what} integer, found {t or 'EOF'}")
        return int(t.value)

    def node(self) -> NodePattern:
        self.expect("(")
        var = self.ident("node variable identifier")
        label = self.ident("label identifier") if self.take(":") else None
        self.expect(")")
        return NodePattern(var, label)

    def predicate(self) -> Predicate:
        var = self.ident("WHERE expression")
        self.expect(".")
        prop = self.ident("property name after '.'")
        t = self.next()
        if t is not None and t.kind == "sign" and t.value in _COMPARE:
            return Predicate(var, prop, str(t.value), self.literal())
        if t is not None and t.kind == "keyword":
            if t.value == "STARTS":
                self.expect("WITH")
                return Predicate(var, prop, "STARTS_WITH", self.literal())
            if t.value == "CONTAINS":
                return Predicate(var, prop, "CONTAINS", self.literal())
            if t.value == "IN":
                self.expect("[")
                values = []
                if not self.sees("]"):
                    values.append(self.literal())
                    while self.take(","):
                        values.append(self.literal())
                self.expect("]")
                return Predicate(var, prop, "IN", tuple(values))
        raise ParseError(f"expected comparison/STARTS WITH/CONTAINS/IN in WHERE, found {t or 'EOF'}")

    def literal(self) -> object:
        """A quoted true, false or null is that value too."""
        t = self.next()
        if t is not None and t.kind == "string":
            return {"true": True, "false": False, "null": None}.get(t.value, t.value)
        if t is not None and t.kind in ("int", "float"):
            return t.value
        raise ParseError(f"expected literal, found {t or 'EOF'}")

    def alias(self) -> str | None:
        return self.ident("alias identifier after AS") if self.take("AS") else None

    def item(self) -> Item:
        if self.take("COUNT"):
            self.expect("(")
            if self.take("*"):
                self.expect(")")
                return Item("count_star", alias=self.alias())
            var = self.ident("'*' or variable inside COUNT")
            self.expect(")")
            return Item("count", var, alias=self.alias())
        var = self.ident("variable identifier in RETURN")
        if self.take("."):
            return Item("prop", var, self.ident("property name after '.'"), self.alias())
        return Item("var", var, alias=self.alias())

    def order(self) -> Order:
        self.expect("ORDER")
        self.expect("BY")
        var = self.ident("identifier in ORDER BY")
        prop = self.ident("property name after '.'") if self.take(".") else None
        descending = self.take("DESC")
        if not descending:
            self.take("ASC")
        return Order(var, prop, descending)

    def limit(self) -> int | None:
        if not self.take("LIMIT"):
            return None
        t = self.next()
        if t is None or t.kind != "int":
            raise ParseError(f"expected integer after LIMIT, found {t or 'EOF'}")
        if t.value < 1:
            raise ParseError(f"LIMIT must be positive, got {t.value}")
        return int(t.value)
