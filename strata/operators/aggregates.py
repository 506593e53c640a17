"""Aggregates over a relationship: grouped by the foreign key below, joined to the rows above."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.predicate import Predicate
from strata.operators.query import ordering, restrict

KINDS = ("count", "sum", "avg", "min", "max", "first", "list", "exists")


@dataclass(frozen=True)
class Relationship:
    """Rows of ``resource`` whose ``foreign`` attribute is this row's ``own`` attribute."""

    resource: str
    own: str
    foreign: str


@dataclass(frozen=True)
class Aggregate:
    """``first`` and ``list`` need a ``sort`` without ties; they leave nulls out."""

    name: str
    kind: str
    relationship: str
    field: str | None = None
    filter: Predicate | None = None
    sort: tuple[tuple[str, str], ...] = ()


class AggregateNotSupported(Exception):
    """An aggregate that no store can answer is never left out in silence."""


def grouped(child: DataFrame, foreign: str, a: Aggregate) -> DataFrame:
    """(foreign key, value) of the children; a shuffle on the key with partial sums before it."""
    if a.kind not in KINDS:
        raise AggregateNotSupported(f"{a.name}: no aggregate of kind {a.kind!r}")
    child = restrict(child, a.filter).where(F.col(f"`{foreign}`").isNotNull())
    value = F.col(f"`{a.field}`") if a.field else F.lit(1)
    if a.kind in ("first", "list"):
        if not a.sort:
            raise AggregateNotSupported(f"{a.name}: {a.kind} needs a sort")
        child = child.where(value.isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(foreign).orderBy(*ordering(a.sort))))
        if a.kind == "first":
            child, out = child.where("_nth = 1"), F.min(value)
        else:
            out = F.transform(F.array_sort(F.collect_list(F.struct("_nth", value.alias("v")))), lambda x: x["v"])
    else:
        out = {"count": F.count(F.lit(1)), "sum": F.sum(value), "avg": F.avg(value), "min": F.min(value), "max": F.max(value), "exists": F.lit(True)}[a.kind]
    return child.groupBy(F.col(f"`{foreign}`").alias("_key")).agg(out.alias(a.name))


def stitched(rows: DataFrame, own: str, values: DataFrame, a: Aggregate, element) -> DataFrame:
    """``rows`` with the aggregate; rows without children get what their kind has for none."""
    out = rows.join(values, rows[own] == values["_key"], "left").drop("_key")
    if a.kind == "count":
        return out.withColumn(a.name, F.coalesce(a.name, F.lit(0).cast("long")))
    if a.kind == "exists":
        return out.withColumn(a.name, F.coalesce(a.name, F.lit(False)))
    if a.kind == "list":
        return out.withColumn(a.name, F.coalesce(a.name, F.array().cast(f"array<{element.simpleString()}>")))
    return out
