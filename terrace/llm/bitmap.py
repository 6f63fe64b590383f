"""A bitmap of fixed size over 64-bit hashes: what it refuses was never put in; the rest is settled exactly afterwards."""

from __future__ import annotations

import math

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the bound on all bits as a power of two (64 MB).
EACH, MOST = 16, 29


class Bitmap:
    """Membership by the leading bits of evenly spread hashes. Only the bounded words of the map are sent to the driver and broadcast."""

    def __init__(self, power: int, words: Broadcast):
        self.power, self.words = power, words

    @classmethod
    def of(cls, hashes: DataFrame) -> Bitmap:
        """The map of all hashes in the one long column of ``hashes``. More of them than the map is made for cost false positives, nothing else."""
        spark, name = hashes.sparkSession, hashes.columns[0]
        power = min(MOST, max(12, math.ceil(math.log2(EACH * hashes.count() + 1))))
        at = F.shiftrightunsigned(F.col(name), 64 - power)
        # One row for each 64-bit word at most, whatever the number of hashes.
        found = (hashes.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - power}) & 63 AS int))").alias("bits"))
                 .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
        words = np.zeros(1 << (power - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(power, spark.sparkContext.broadcast(words))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each unsigned 64-bit hash may be in the map."""
        at = hashes >> np.uint64(64 - self.power)
        return (self.words.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
