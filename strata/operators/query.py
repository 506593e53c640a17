"""Queries as values and their compilation: filter, calculations, distinct, sort, offset, limit, projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.predicate import Predicate, all_of, references, to_column


@dataclass(frozen=True)
class Calculation:
    """A column computed for each row, as Spark SQL. ``source_only``: only the source of truth can compute it."""

    name: str
    sql: str
    source_only: bool = False


@dataclass(frozen=True)
class Query:
    resource: str
    filter: Predicate | None = None
    select: tuple[str, ...] | None = None
    sort: tuple[tuple[str, str], ...] = ()  # name, asc or desc
    distinct: tuple[str, ...] = ()
    distinct_sort: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None
    calculations: tuple[str, ...] = ()
    aggregates: tuple[str, ...] = ()
    tenant: str | None = None
    lock: bool = False
    context: Mapping = field(default_factory=dict, hash=False)

    def where(self, p: Predicate) -> Query:
        """Filters add up."""
        return replace(self, filter=all_of((self.filter, p)))

    def fields(self, *names: str) -> Query:
        return replace(self, select=names)

    def order(self, *by: str | tuple[str, str]) -> Query:
        return replace(self, sort=tuple((b, "asc") if isinstance(b, str) else b for b in by))

    def take(self, limit: int | None = None, offset: int | None = None) -> Query:
        return replace(self, limit=limit, offset=offset)

    def load(self, *calculations: str) -> Query:
        return replace(self, calculations=self.calculations + calculations)

    def with_aggregates(self, *names: str) -> Query:
        return replace(self, aggregates=self.aggregates + names)

    def distinct_on(self, *names: str, by: tuple[tuple[str, str], ...] = ()) -> Query:
        return replace(self, distinct=names, distinct_sort=by)

    def for_tenant(self, tenant: str | None) -> Query:
        return replace(self, tenant=tenant)

    def read_from(self, layer: str) -> Query:
        return replace(self, context={**self.context, "read_from": layer})

    @property
    def recordable(self) -> bool:
        """Does the answer hold every row of the filter?"""
        return self.limit is None and not self.offset and not self.distinct and not self.distinct_sort and not self.lock


def ordering(by: tuple[tuple[str, str], ...]) -> list[Column]:
    """Nulls come last in either direction."""
    return [F.col(f"`{n}`").desc_nulls_last() if d == "desc" else F.col(f"`{n}`").asc_nulls_last() for n, d in by]


def needed_fields(q: Query, names: list[str], keys: tuple[str, ...], calculations: Mapping[str, Calculation]) -> frozenset[str]:
    """Stored fields that the query shows, or reads on the way."""
    used = set(q.select if q.select is not None else names) | set(keys) | references(q.filter, names) | set(q.distinct)
    used |= {n for n, _ in (*q.sort, *q.distinct_sort)}
    for c in {*q.calculations, *used} & set(calculations):
        from strata.functions.predicate import Opaque

        used |= references(Opaque(calculations[c].sql), names)
    return frozenset(used & set(names))


def restrict(df: DataFrame, p: Predicate | None) -> DataFrame:
    return df if p is None else df.where(to_column(p))


def compile_query(q: Query, df: DataFrame, names: list[str], keys: tuple[str, ...], calculations: Mapping[str, Calculation], skip: frozenset[str] = frozenset()) -> DataFrame:
    """``q`` on the rows of one store. ``skip``: calculations that come from elsewhere."""
    df = restrict(df, q.filter)
    used = {n for n, _ in (*q.sort, *q.distinct_sort)} | set(q.distinct) | set(q.calculations)
    for c in [calculations[n] for n in calculations if n in used and n not in skip]:
        df = df.withColumn(c.name, F.expr(c.sql))
    if q.distinct:  # one row for each combination, chosen by an order that has no ties
        by = ordering(q.distinct_sort or q.sort) + ordering(tuple((k, "asc") for k in keys))
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*q.distinct).orderBy(*by))).where("_nth = 1").drop("_nth")
    if q.sort:
        df = df.orderBy(*ordering(q.sort))
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    shown = [n for n in (q.select if q.select is not None else names)]
    return df.select(*shown, *[c for c in q.calculations if c not in skip and c not in shown])
