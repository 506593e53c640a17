"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Both steps are joins and aggregations with map-side combining; links are written to shared storage after each round,
and nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.storage import materialise, remove


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` but the roots themselves; root is the least node of the component.

    Self-links and repeated links do no harm; nulls are not nodes. An empty link table gives no rows.
    """
    edges = links.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u")).where("v <> u").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))  # u < v, so m is below v
        # Small star: every smaller neighbour of v, and v itself, links to the least of them.
        small = edges.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        # Large star: the larger neighbours of a node link to its least neighbour.
        low = small.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        large = small.join(low, small["u"] == low["c"], "left")
        large = large.select("v", F.coalesce("m", "u").alias("u")).where("v <> u").distinct()
        after = materialise(large, "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        remove(edges.sparkSession, edges) if state[0] else None
        edges = after
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
