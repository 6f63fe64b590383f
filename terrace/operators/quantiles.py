"""Exact quantiles and outlier fences by radix selection, without gathering or writing a column.

Doubles become 64-bit numbers in the same order. Rows are counted by the leading bits of that number, which says in
which bin a rank lies; the next count looks at the rows of that bin only, by their next bits. Counts are combined
in each task, a bin's rows are never brought together, and all ranks of all columns take part in the same few passes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace import constants as K

#: Bits of a step. A bin with no more rows than a step has counts is resolved at once.
STEP = 16
_SIGN, _REST = 1 << 63, (1 << 63) - 1


@dataclass
class Quantiles:
    count: int
    values: list[float | None]


@dataclass(frozen=True)
class _Bin:
    """Rows of a column whose first ``depth`` bits are ``prefix``, to be counted by their next ``take`` bits."""

    column: int
    prefix: int = 0
    depth: int = 0
    take: int = STEP


@dataclass(frozen=True)
class _Target:
    """A rank of a column being located: the bin that holds it, and the rank among that bin's rows."""

    rank: int
    bin: _Bin
    inside: int


def double(number: int) -> float:
    """The double that a number in the order of doubles stands for."""
    bits = number ^ _SIGN if number & _SIGN else number ^ (_SIGN | _REST)
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float]
) -> dict[str, Quantiles]:
    """Linearly interpolated quantiles of numeric expressions, nulls and NaN left out."""
    if not columns:
        return {}
    doubles = df.select(*[F.nanvl(v.cast("double"), F.lit(None)).alias(f"c{i}")
                          for i, v in enumerate(columns.values())])
    last = F.col("total") - 1
    ends = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(last * p).cast("long"), F.ceil(last * p).cast("long")) for p in probs
    ])))
    counts, found = [0] * len(columns), {}
    targets: list[_Target] = []
    first = [_Bin(i) for i in range(len(columns))]
    for r in _holding(doubles, first, ends):
        counts[r.bin] = r.total
        targets += [_deeper(_Target(rank, first[r.bin], rank), r) for rank in r.ranks]
    while targets:
        bins = list(dict.fromkeys(t.bin for t in targets))
        ranks = F.create_map(*[x for i, b in enumerate(bins) for x in (
            F.lit(i), F.array(*[F.lit(rank).cast("long") for rank in sorted({t.inside for t in targets if t.bin == b})]))])
        at = {(bins[r.bin], rank): r for r in _holding(doubles, bins, ranks[F.col("bin")]) for rank in r.ranks}
        moved = [_deeper(t, at[t.bin, t.inside]) for t in targets]
        found.update({(t.bin.column, t.rank): double(t.bin.prefix) for t in moved if t.bin.depth == 64})
        targets = [t for t in moved if t.bin.depth < 64]

    def quantile(i: int, p: float) -> float | None:
        if not counts[i]:
            return None
        position = (counts[i] - 1) * p
        low, high = found[i, math.floor(position)], found[i, math.ceil(position)]
        return low if low == high else low + (high - low) * (position - math.floor(position))

    return {n: Quantiles(counts[i], [quantile(i, p) for p in probs]) for i, n in enumerate(columns)}


def _deeper(target: _Target, holding) -> _Target:
    """The target in the part of its bin that holds it."""
    old = target.bin
    depth = old.depth + old.take
    take = 64 - depth if holding.n <= 1 << STEP else min(STEP, 64 - depth)
    new = replace(old, prefix=old.prefix << old.take | holding.part, depth=depth, take=take)
    return _Target(target.rank, new, target.inside - holding.start)


def _holding(doubles: DataFrame, bins: list[_Bin], ranks: Column) -> list:
    """The parts of bins that hold one of the bin's ranks: bin, part, n, start, total and those ranks."""

    plan = [(b.column, b.prefix, b.depth, b.take) for b in bins]
    step, rest, sign = STEP, _REST, _SIGN  # the function is sent to workers that need not have this package

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = {i: np.zeros(1 << step, np.int64) for i, b in enumerate(plan) if b[3] == step}
        few: dict[int, list[np.ndarray]] = {i: [] for i, b in enumerate(plan) if b[3] != step}
        for batch in batches:
            of: dict[int, np.ndarray] = {}
            for i, (column, prefix, depth, take) in enumerate(plan):
                if column not in of:
                    values = batch.column(column).to_numpy(zero_copy_only=False)
                    # In the order of the doubles; both zeros are one.
                    bits = (values[~np.isnan(values)] + 0.0).view(np.int64)
                    of[column] = (bits ^ ((bits >> 63) & rest)).view(np.uint64) ^ np.uint64(sign)
                part = of[column]
                if depth:
                    part = part[part >> np.uint64(64 - depth) == np.uint64(prefix)]
                part = (part >> np.uint64(64 - depth - take) & np.uint64((1 << take) - 1)).astype(np.int64)
                if i in steps:
                    steps[i] += np.bincount(part, minlength=1 << step)
                else:
                    few[i].append(part)  # no more rows than a step has counts
        for i in range(len(plan)):
            if i in steps:
                part = np.flatnonzero(steps[i])
                n = steps[i][part]
            else:
                part, n = np.unique(np.concatenate(few[i] or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(part), i, np.int32)), pa.array(part, pa.int64()), pa.array(n, pa.int64())], names=["bin", "part", "n"])

    parts = doubles.mapInArrow(count, "bin int, part long, n long").groupBy("bin", "part").agg(F.sum("n").alias("n"))
    # At most one row for each part of a step meets in a window.
    whole = Window.partitionBy("bin")
    upto = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = parts.select("bin", "part", "n", (upto - F.col("n")).alias("start"), F.sum("n").over(whole).alias("total"))
    own = F.filter(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    # Two rows for each quantile at most.
    return running.withColumn("ranks", own).filter(F.size("ranks") > 0).collect()


def iqr_fences(
    df: DataFrame, columns: dict[str, Column], at_least: int
) -> dict[str, tuple[float, float]]:
    """Outlier fences per column that has ``at_least`` values and a spread."""
    fences = {}
    for name, q in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q.count >= at_least and q.values[1] > q.values[0]:
            reach = K.IQR_FENCE * (q.values[1] - q.values[0])
            fences[name] = (q.values[0] - reach, q.values[1] + reach)
    return fences


def outside(value: Column, fence: tuple[float, float]) -> Column:
    return (value < fence[0]) | (value > fence[1])
