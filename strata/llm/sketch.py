"""Bloom filters of a bounded size: they spare shuffles of rows that surely have no partner, and decide nothing alone.

Whatever passes a filter meets an exact join afterwards, so a filter that is full (more keys than its bits hold well)
only lets more rows through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most of them: 8 MiB reach the driver and the tasks at any size of the corpus.
BITS_PER_KEY, MOST_BITS = 16, 1 << 26
PROBES = 4


class Bloom:
    """Membership of 64-bit keys that are hashes already."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bloom:
        """The filter of a long column. Its words are or-ed together by an aggregation; the driver gets one row a word."""
        n = keys.count()
        bits = 1 << max(16, int(BITS_PER_KEY * max(n, 1) - 1).bit_length())
        bits = min(bits, MOST_BITS)
        low = F.col(column).bitwiseAND(F.lit(bits - 1))
        step = F.shiftrightunsigned(F.col(column), 32).bitwiseOR(F.lit(1).cast("long"))
        at = F.explode(F.array(*[(low + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]))
        rows = keys.where(F.col(column).isNotNull()).select(at.alias("at"))
        rows = rows.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
        got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        words = np.zeros(bits // 64, np.uint64)
        words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        key = np.ascontiguousarray(keys).view(np.uint64)
        mask = np.uint64(len(self.words) * 64 - 1)
        low, step = key & mask, (key >> np.uint64(32)) | np.uint64(1)
        out = np.ones(len(key), bool)
        for i in range(PROBES):
            at = (low + step * np.uint64(i)) & mask
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out
