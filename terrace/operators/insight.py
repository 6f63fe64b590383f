"""INSIGHT: notable facts about a table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col, number_columns, text_columns
from terrace.functions.numbers import as_number
from terrace.operators.quantiles import iqr_fences, outside

SCHEMA = "kind string, column string, column2 string, value double, text string"


def insights(df: DataFrame) -> DataFrame:
    """Facts as rows ``(kind, column, column2, value, text)``.

    Size, spread of the first three numeric columns, outliers of the first two, strongly
    correlated pairs, and the most frequent value of the first two text columns. Only aggregates
    leave the cluster.
    """
    return df.sparkSession.createDataFrame(_facts(df), SCHEMA)


def narratives(df: DataFrame) -> list[str]:
    return [fact[4] for fact in _facts(df) if fact[4]]


def _facts(df: DataFrame) -> list[tuple]:
    numbers = {n: as_number(df, n) for n in number_columns(df)}
    spread, fenced = list(numbers)[:3], list(numbers)[:2]
    fences = iqr_fences(df, {n: numbers[n] for n in fenced}, K.INSIGHT_MIN_VALUES + 1)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(spread):
        measures += [f(numbers[n]).alias(f"{k}{i}") for k, f in
                     (("mean", F.avg), ("max", F.max), ("min", F.min))]
    for i, n in enumerate(fences):
        out = outside(numbers[n], fences[n])
        measures += [
            F.count_if(out).alias(f"outliers{i}"),
            F.max(F.when(out, numbers[n])).alias(f"extreme{i}"),
        ]
    row = df.agg(*measures).first()
    say = K.INSIGHT_TEXT

    facts = [(
        "size", None, None, float(row.rows),
        say["size"].format(rows=row.rows, columns=len(df.columns)),
    )]
    for i, n in enumerate(spread):
        mean, top, low = row[f"mean{i}"], row[f"max{i}"], row[f"min{i}"]
        if mean is not None:
            text = say["summary"].format(column=n, mean=mean, max=top, min=low)
            facts.append(("mean", n, None, float(mean), text))
            facts.append(("max", n, None, float(top), None))
            facts.append(("min", n, None, float(low), None))
    for i, n in enumerate(fences):
        count, top = row[f"outliers{i}"], row[f"extreme{i}"]
        if count:
            text = say["outliers"].format(column=n, count=count, max=top)
            facts.append(("outliers", n, None, float(count), text))
    related = correlations(df).filter(F.abs("r") >= K.STRONG_CORRELATION).filter("not isnan(r)")
    place = {n: i for i, n in enumerate(numbers)}
    for a, b, r in sorted(related.collect(), key=lambda p: (place[p[0]], place[p[1]])):
        strength = K.CORRELATION_STRENGTH[abs(r) >= K.VERY_STRONG_CORRELATION]
        text = say["correlation"].format(column=a, column2=b, r=r, strength=strength)
        facts.append(("correlation", a, b, r, text))
    for n in text_columns(df)[:2]:
        top = most_frequent(df, n).first()
        if top:
            text = say["category"].format(
                column=n, value=top.value, count=top.rows, share=top.rows / row.rows * 100
            )
            facts.append(("category", n, top.value, float(top.rows), text))
    return facts


def most_frequent(df: DataFrame, name: str) -> DataFrame:
    """The most frequent value of a column and its rows; the smallest value on a tie."""
    return (
        df.filter(col(name).isNotNull())
        .groupBy(col(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "value")
        .limit(1)
    )


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows that have both.

    Null for fewer than two such rows; NaN where a column does not vary over them or holds an infinity. Each task
    adds up the products of all pairs at once, as matrices of its columns and of what is present in
    them; one row for each pair and task is shuffled.
    """
    names = number_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column string, column2 string, r double")
    cells = df.select(*[as_number(df, n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    ends = cells.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in cells.columns for f in (F.min, F.max, F.avg)]).first()
    # Sums around a value amid the column's keep their digits; a constant column becomes exactly zero.
    shifts = []
    for c in cells.columns:
        low, high, mean = (ends[f"{f}_{c}"] for f in ("min", "max", "avg"))
        middle = low if low == high else mean
        shifts.append(middle if middle is not None and math.isfinite(middle) else 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(shifts)
        total = np.zeros((7, count, count))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shifts
            there, infinite = ~np.isnan(x), np.isinf(x)
            x = np.where(there & ~infinite, x, 0.0)
            m, wild = there.astype(float), infinite.astype(float)
            square = x * x
            # Rows with both; sums and squares of the first over rows of the second, and the other way round; products; infinities.
            total += [m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x, wild.T @ m + m.T @ wild]
        i, j = np.triu_indices(count, 1)
        yield pa.record_batch([pa.array(k.astype(np.int32)) for k in (i, j)] + [pa.array(t[i, j]) for t in total], names=["i", "j", *sums])

    sums = ("n", "x", "y", "xx", "yy", "xy", "wild")
    paired = cells.mapInArrow(products, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    whole = paired.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    spread = [F.col("n") * F.col(s + s) - F.col(s) * F.col(s) for s in ("x", "y")]
    steady = [v <= F.lit(1e-13) * F.col("n") * F.col(s + s) for v, s in zip(spread, ("x", "y"))]
    r = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.sqrt(spread[0]) * F.sqrt(spread[1]))
    label = F.array(*[F.lit(n) for n in names])
    return whole.select(
        label[F.col("i")].alias("column"), label[F.col("j")].alias("column2"),
        F.when(F.col("n") < 2, F.lit(None)).when((F.col("wild") > 0) | steady[0] | steady[1], F.lit(float("nan")))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )
