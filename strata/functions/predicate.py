"""Filter trees: built in Python or parsed from SQL, compiled to Catalyst columns, readable by the prover.

>>> (attr("age") >= 18) & attr("name").isin("a", "b")

A node that the prover cannot read (a function call, a comparison of two attributes) is an :class:`Opaque` node: it still runs, as
Spark SQL, but nothing is ever proven about the filter that holds it.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

COMPARISONS = ("eq", "not_eq", "lt", "lte", "gt", "gte")


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    op: str
    name: str
    value: object


@dataclass(frozen=True)
class In(Predicate):
    name: str
    values: tuple


@dataclass(frozen=True)
class IsNil(Predicate):
    name: str
    nil: bool = True


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Always(Predicate):
    value: bool


@dataclass(frozen=True)
class Opaque(Predicate):
    sql: str


class attr:  # noqa: N801  reads as a word in filters
    """An attribute in a filter; ``5 < attr("x")`` is ``attr("x") > 5``, as Python flips it."""

    def __init__(self, name: str):
        self.name = name

    __hash__ = None  # type: ignore[assignment]

    def __eq__(self, v) -> Predicate:  # type: ignore[override]
        return Compare("eq", self.name, v)

    def __ne__(self, v) -> Predicate:  # type: ignore[override]
        return Compare("not_eq", self.name, v)

    def __lt__(self, v) -> Predicate:
        return Compare("lt", self.name, v)

    def __le__(self, v) -> Predicate:
        return Compare("lte", self.name, v)

    def __gt__(self, v) -> Predicate:
        return Compare("gt", self.name, v)

    def __ge__(self, v) -> Predicate:
        return Compare("gte", self.name, v)

    def isin(self, *values) -> Predicate:
        return In(self.name, tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values)

    def is_nil(self, nil: bool = True) -> Predicate:
        return IsNil(self.name, nil)


def all_of(parts: Iterable[Predicate | None]) -> Predicate | None:
    """The conjunction of what is there; none: no filter."""
    parts = tuple(p for p in parts if p is not None)
    return parts[0] if len(parts) == 1 else And(parts) if parts else None


def to_column(p: Predicate | None) -> Column:
    """The filter as a column. Null means: not matched, as in any Spark filter."""
    match p:
        case None:
            return F.lit(True)
        case Always(value):
            return F.lit(value)
        case Compare(op, name, value):
            c, v = F.col(f"`{name}`"), F.lit(value)
            return {"eq": c == v, "not_eq": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[op]
        case In(name, values):
            return F.col(f"`{name}`").isin(list(values)) if values else F.lit(False)
        case IsNil(name, nil):
            return F.col(f"`{name}`").isNull() if nil else F.col(f"`{name}`").isNotNull()
        case And(parts):
            return reduce(lambda a, b: a & b, map(to_column, parts), F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, map(to_column, parts), F.lit(False))
        case Not(part):
            return ~to_column(part)
        case Opaque(sql):
            return F.expr(sql)
    raise TypeError(f"not a filter: {p!r}")


def references(p: Predicate | None, attributes: Iterable[str]) -> set[str]:
    """Names that a filter reads. Of SQL text: every attribute whose name occurs in it as a word."""
    match p:
        case Compare(_, name, _) | In(name, _) | IsNil(name, _):
            return {name}
        case And(parts) | Or(parts):
            return set().union(*(references(x, attributes) for x in parts))
        case Not(part):
            return references(part, attributes)
        case Opaque(sql):
            return {a for a in attributes if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", sql)}
    return set()


def _kind(value) -> str:
    return "nil" if value is None else "timestamp" if isinstance(value, dt.datetime) else type(value).__name__


def shape(p: Predicate | None) -> str:
    """The filter without its literals: what telemetry may show."""
    match p:
        case None:
            return "all"
        case Always(value):
            return str(value).lower()
        case Compare(op, name, value):
            return f"{op}({name},{_kind(value)})"
        case In(name, values):
            return f"in({name},{','.join(sorted({_kind(v) for v in values}))})"
        case IsNil(name, nil):
            return f"{'is' if nil else 'not'}_nil({name})"
        case And(parts):
            return f"and({','.join(map(shape, parts))})"
        case Or(parts):
            return f"or({','.join(map(shape, parts))})"
        case Not(part):
            return f"not({shape(part)})"
    return "opaque"


def evaluate(p: Predicate | None, row: dict) -> bool | None:
    """The filter on one row in three-valued logic; an independent check of the column form. No SQL text."""
    match p:
        case None:
            return True
        case Always(value):
            return value
        case IsNil(name, nil):
            return (row[name] is None) == nil
        case Compare(op, name, value):
            x = row[name]
            if x is None or value is None:
                return None
            return {"eq": x == value, "not_eq": x != value, "lt": x < value, "lte": x <= value, "gt": x > value, "gte": x >= value}[op]
        case In(name, values):
            return evaluate(Or(tuple(Compare("eq", name, v) for v in values)), row)
        case And(parts):
            got = [evaluate(x, row) for x in parts]
            return False if False in got else None if None in got else True
        case Or(parts):
            got = [evaluate(x, row) for x in parts]
            return True if True in got else None if None in got else False
        case Not(part):
            got = evaluate(part, row)
            return None if got is None else not got
    raise TypeError(f"can't evaluate {p!r}")


_SQL_COMPARISONS = {"EqualTo": "eq", "LessThan": "lt", "LessThanOrEqual": "lte", "GreaterThan": "gt", "GreaterThanOrEqual": "gte"}
_FLIPPED = {"eq": "eq", "not_eq": "not_eq", "lt": "gt", "lte": "gte", "gt": "lt", "gte": "lte"}


def parse(spark: SparkSession, sql: str) -> Predicate:
    """A filter from SQL text by Catalyst's own parser; what has no node here stays SQL text."""
    return _walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(sql))


class _NotALiteral(Exception):
    pass


def _literal(e):
    name = e.getClass().getSimpleName()
    if name == "UnaryMinus":
        return -_literal(e.child())
    if name != "Literal":
        raise _NotALiteral
    value, kind = e.value(), e.dataType().typeName()
    if value is None:
        return None
    if kind.startswith("decimal"):
        return Decimal(value.toString())
    if kind == "date":
        return dt.date(1970, 1, 1) + dt.timedelta(days=value)
    if kind.startswith("timestamp"):
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
    return value if isinstance(value, (bool, int, float, str)) else value.toString()


def _name(e) -> str | None:
    parts = e.nameParts() if e.getClass().getSimpleName() == "UnresolvedAttribute" else None
    return parts.head() if parts is not None and parts.size() == 1 else None


def _walk(e) -> Predicate:
    kind = e.getClass().getSimpleName()
    try:
        if kind == "And":
            return And((_walk(e.left()), _walk(e.right())))
        if kind == "Or":
            return Or((_walk(e.left()), _walk(e.right())))
        if kind == "Not":
            if e.child().getClass().getSimpleName() == "EqualTo":
                inner = _walk(e.child())
                return Compare("not_eq", inner.name, inner.value) if isinstance(inner, Compare) else Not(inner)
            return Not(_walk(e.child()))
        if kind in ("IsNull", "IsNotNull") and _name(e.child()):
            return IsNil(_name(e.child()), kind == "IsNull")
        if kind == "In" and _name(e.value()):
            values = e.list()
            return In(_name(e.value()), tuple(_literal(values.apply(i)) for i in range(values.size())))
        if kind in _SQL_COMPARISONS:
            op = _SQL_COMPARISONS[kind]
            if name := _name(e.left()):
                return Compare(op, name, _literal(e.right()))
            if name := _name(e.right()):
                return Compare(_FLIPPED[op], name, _literal(e.left()))
        if kind == "Literal" and isinstance(e.value(), bool):
            return Always(e.value())
    except _NotALiteral:
        pass
    return Opaque(e.sql())
