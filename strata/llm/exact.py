"""Exact dedup with a heavy-hitter split, in built-in functions only.

1. One scan makes a narrow table: doc_id, digest of the normalised text, code points. It is written once.
2. A Misra-Gries summary (``freqItems``, which keeps 1 / support counters per task and merges them) names every digest
   with more than ``support`` of the rows, perhaps others too. Its size is bounded by 1 / support.
3. The candidates' exact counts and winners are verified by a map-side aggregation and broadcast; their rows are
   settled without a shuffle.
4. The other digests go through an ordinary shuffle, in which no group can hold more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.storage import materialise

#: A digest with more than this share of the rows is surely a heavy hitter; at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001
_SPACE = " \t\n\x0b\x0c\r"


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when they are once [\\x20\\x09-\\x0D] is deleted; null counts as empty, and all empty texts are one
    group. Of a group stays the row with the most code points in the original text, then the smallest doc_id (nulls
    last). Of rows that repeat with the same doc_id and length just one is kept. An empty table gives no rows; columns
    other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, _SPACE, "").cast("binary"), 256)).alias("digest"),
        F.char_length(text).alias("n"),
    )
    # The same row twice: counted here, and given out again at the end with one copy kept at most.
    base = base.groupBy("doc_id", "digest", "n").agg(F.count(F.lit(1)).alias("copies"))
    base = materialise(base.withColumn("h", F.xxhash64("digest")), "digests")
    rank = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"))

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min(rank).alias("best"), F.sum("copies").alias("group_size"))

    names = base.stat.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    heavy = winners(base.join(F.broadcast(names), "h", "left_semi")).where("group_size > 1")
    heavy = F.broadcast(materialise(heavy, "heavy"))

    settled = base.join(heavy, "digest")
    rest = base.join(heavy, "digest", "left_anti")
    light = rest.join(winners(rest), "digest")
    wins = (F.col("n") == -F.col("best.n")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    out = settled.unionByName(light).withColumn("wins", wins)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("wins") & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t, length(coalesce(text, '')) as n
  from documents),
r as (
  select doc_id, t, count(*) over (partition by t) as group_size,
    row_number() over (partition by t order by n desc, doc_id nulls last) as r,
    first_value(doc_id) over (partition by t order by n desc, doc_id nulls last) as keep_id
  from d)
select doc_id, keep_id, cast(group_size as bigint) as group_size, r = 1 as kept, sha256(t) as text_sha256 from r
"""
