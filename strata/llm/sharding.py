"""Sharding by jump consistent hashing.

The shard of a document is decided by its key and the number of shards alone (Lamping and Veach, 2014): there is no
ring table, and growing from n to n + 1 shards moves about 1 / (n + 1) of the rows, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.ranks import running_total
from strata.llm.storage import materialise

_STEP = np.uint64(2862933555777941757)
#: Order-preserving slices of a shard; a task ranks one slice of one shard.
SLOT_BUCKETS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards (0 to ``shards`` - 1) of 64-bit keys; all keys jump in lockstep until each has left the range."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), dtype=np.int32)
    live = np.arange(len(key))
    at = np.zeros(len(key), dtype=np.float64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = at
            key = key * _STEP + np.uint64(1)
            ratio = float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            at = np.floor((out[live].astype(np.float64) + 1.0) * ratio)
            stay = at < shards
            live, key, at = live[stay], key[stay], at[stay]
    return out


def _jump_udf(shards: int):
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return jump


def with_shard(df: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add the shard of every row; a null key counts as -1. Only the key column goes through Python."""
    return df.withColumn(out, _jump_udf(shards)(F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    size: UTF-8 bytes of the text (null: 0) plus 16. slot: gapless from 0 in each shard, by a slice of the doc_id's
    bits and then by doc_id, size and checksum (nulls first); rows that repeat take neighbouring slots in either order.
    grown_shard: the shard if there were one more. A null text counts as empty, a null doc_id as key -1; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    base = with_shard(with_shard(base, shards), shards + 1, out="grown_shard")
    base = base.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int"))
    base = materialise(base, "shards")
    ranked = running_total(base, "shard", "_slice", ["doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
