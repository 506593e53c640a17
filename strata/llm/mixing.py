"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target (words that the mix takes from it) and a weight schedule over training progress 0 to 1. The
schedule is integrated to a cumulative word demand; a document's place in the source's own word order is inverted
through that demand to a training position, and documents are range-sorted by it. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.ranks import running_total
from strata.llm.storage import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: No source is taken more often than this.
MAX_REPEATS = 3


@dataclass(frozen=True)
class Schedule:
    """Piecewise-linear weight over progress: ((0.0, w0), ..., (1.0, wn)), each w positive."""

    knots: tuple[tuple[float, float], ...]

    def integral(self) -> list[tuple[float, float, float, float, float]]:
        """Segments (progress at start, length, weight at start, at end, demand before), demand scaled to end at 1."""
        parts, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            parts.append((t0, t1 - t0, w0, w1, total))
            total += (t1 - t0) * (w0 + w1) / 2
        return [(t, d, w0 / total, w1 / total, before / total) for t, d, w0, w1, before in parts]

    def invert(self, demand: Column) -> Column:
        """Progress at which this share (0 to 1) of the demand has been met."""
        out = None
        for t0, length, w0, w1, before in self.integral():
            rest = (demand - F.lit(before)) / F.lit(length)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0)) * rest, F.lit(0.0)))
            here = F.lit(t0) + F.lit(length) * (F.lit(2.0) * rest / (F.lit(w0) + root))
            out = here if out is None else F.when(demand >= F.lit(before), here).otherwise(out)
        return out


#: By the weight's place in the cycle: the light sources come late, the heavy ones early.
SCHEDULES = (Schedule(((0.0, 0.5), (1.0, 1.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 1.5), (1.0, 0.5))))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, place (of the weight in the cycle 1, 2, 3) and target for (source, source_key, size) rows.

    Water level: sorted by the ratio of limit to weight, those before the first source whose fair share fits under its
    limit stand at the limit; the others share the rest by weight. One row per source is in these windows, no document.
    """
    per = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", (F.row_number().over(by_name) - 1) % 3).withColumn("w", (F.col("place") + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * MAX_REPEATS)
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("ord", F.row_number().over(by_ratio))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("rest_w").cast("double"))
        .withColumn("open", F.col("level") <= F.col("cap").cast("double") / F.col("w").cast("double"))
        .withColumn("first", F.min(F.when(F.col("open"), F.col("ord"))).over(everything))
        .withColumn("final", F.max(F.when(F.col("ord") == F.col("first"), F.col("level"))).over(everything))
    )
    capped = F.col("first").isNull() | (F.col("ord") < F.col("first"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w").cast("double"))
    return per.select("source_key", "source_size", "place", target.alias("target"))


def _sized(docs: DataFrame, carried: list[Column]) -> DataFrame:
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        *carried,
    )
    base = base.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    base = base.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return base.withColumn("_bucket", F.substring("_order", 1, 3))


def _taken(rows: DataFrame, sizes: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with source_size, target, taken and position; ``sizes``: the same rows, as narrow as possible."""
    ranked = running_total(rows, "source_key", "_bucket", order, F.col("size"), "before", sizes)
    out = ranked.join(source_targets(sizes), "source_key")
    words = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    out = out.withColumn("_words", words).withColumn("_safe", F.greatest(F.col("source_size"), F.lit(1)))
    out = out.withColumn("_full", F.expr("_words div _safe")).withColumn("_rest", F.expr("_words % _safe"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    out = out.withColumn("taken", F.col("_full") * F.col("size") + part)
    share = F.col("before").cast("double") / F.greatest(F.col("_words"), F.lit(1)).cast("double")
    position = SCHEDULES[0].invert(share)
    for i, s in enumerate(SCHEDULES[1:], 1):
        position = F.when(F.col("place") == i, s.invert(share)).otherwise(position)
    return out.withColumn("position", F.when(F.col("taken") > 0, position))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position for every row of ``docs``, sorted by position.

    Inside a source, documents stand in the order of md5(doc_id); the mix reads that order again and again until the
    target (to the nearest word) is met, so copies differ by one at most and one document may be taken in part.
    position (0 to 1): training progress at which the first copy starts; null if nothing is taken. A null or empty
    text has size 0; a null source is a source of its own, last in the order of weights; a null doc_id stands in the
    order as the text "null". Repeated rows count each. An empty table gives no rows. Other columns are ignored.
    """
    base = materialise(_sized(docs, []), "sizes")
    out = _taken(base, base, ["_order", "doc_id", "size"])
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as :func:`mix` takes it, sorted by position of first copies.

    A document of which a part is taken comes whole once more, so sources exceed their targets by one document at most.
    Documents that the mix does not reach go, those without words too. The columns are those of ``docs``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    wide = _taken(_sized(docs, [row]), _sized(docs, []), ["_order", "doc_id", "size"]).where("taken > 0")
    copies = F.ceil(F.col("taken").cast("double") / F.col("size").cast("double")).cast("int")
    wide = wide.select("_row", "position", "doc_id", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    return wide.orderBy("position", "doc_id").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'null')) as o
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, cast(3 * sum(size) as bigint) as cap,
         (row_number() over (order by source nulls last) - 1) % 3 as place
  from d group by source),
r as (
  select *, place + 1 as w,
    row_number() over q as ord,
    cast(sum(source_size) over () - coalesce(sum(cap) over p, 0) as double)
      / cast(sum(place + 1) over () - coalesce(sum(place + 1) over p, 0) as double) as level
  from s
  window q as (order by cast(cap as double) / cast(place + 1 as double), source nulls last),
         p as (order by cast(cap as double) / cast(place + 1 as double), source nulls last
               rows between unbounded preceding and 1 preceding)),
f as (select arg_min(level, ord) as final, min(ord) as first from r
      where level <= cast(cap as double) / cast(w as double)),
t as (
  select source, source_size, place,
    case when first is null or ord < first then cast(cap as double) else final * cast(w as double) end as target
  from r left join f on true),
j as (
  select d.*, source_size, target, place, cast(floor(target + 0.5) as bigint) as words,
    cast(coalesce(sum(size) over (partition by d.source order by o, doc_id, size
                             rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from d join t on d.source is not distinct from t.source),
k as (
  select *, cast((words // greatest(source_size, 1)) * size
      + greatest(0, least(size, words % greatest(source_size, 1) - before)) as bigint) as taken,
    cast(before as double) / cast(greatest(words, 1) as double) as u
  from j)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then case place
    when 0 then 0.0::double + 1.0::double * (2.0::double * u / (0.5::double + sqrt(greatest(0.25::double + 2.0::double * u, 0.0::double))))
    when 1 then 0.0::double + 1.0::double * (2.0::double * u / (1.0::double + sqrt(greatest(1.0::double + 0.0::double * u, 0.0::double))))
    else 0.0::double + 1.0::double * (2.0::double * u / (1.5::double + sqrt(greatest(2.25::double + (-2.0)::double * u, 0.0::double)))) end end as position
from k
"""
