"""Prefix sums and gapless ranks over groups of any size.

A group is cut into buckets by a column that agrees with the wanted order. The totals of the buckets are summed in a
small table; inside a bucket an ordinary window runs. No task ever holds more than one bucket of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, bucket: str, order: list[str], value, out: str, narrow: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before, a long.

    ``group`` and ``bucket`` hold no nulls; rows are ordered by bucket and then ``order``. ``narrow``: the same rows,
    with these columns alone, for the totals.
    """
    keys = [group, bucket]
    totals = (df if narrow is None else narrow).groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset")
    )
