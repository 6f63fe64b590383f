"""Data-quality score of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col, number_columns
from terrace.functions.numbers import as_number, no_nan
from terrace.operators.quantiles import iqr_fences, outside


def _present(df: DataFrame) -> list[Column]:
    return [no_nan(col(f.name), f.dataType).isNotNull() for f in df.schema]


def _sum(flags: list[Column]) -> Column:
    ones = [F.coalesce(f, F.lit(False)).cast("bigint") for f in flags]
    return reduce(lambda a, b: a + b, ones, F.lit(0).cast("bigint"))


def row_identity(df: DataFrame) -> Column:
    """128 bits that tell rows apart, so that counting distinct rows moves 16 bytes per row.

    The hashes skip nulls, so which cells are null is hashed along.
    """
    cells = [no_nan(col(f.name), f.dataType) for f in df.schema]
    nulls = F.concat(*[F.when(p, "1").otherwise("0") for p in _present(df)])
    return F.struct(F.xxhash64(nulls, *cells), F.xxhash64(F.lit("second"), nulls, *cells))


def quality(df: DataFrame) -> DataFrame:
    """One row: score, its five parts, and the badge. An empty table scores 100."""
    numbers = {n: as_number(df, n) for n in number_columns(df)}
    fences = iqr_fences(df, numbers, K.QUALITY_MIN_VALUES + 1)
    outliers = _sum([outside(numbers[n], fences[n]) for n in fences])
    counts = df.select(
        _sum(_present(df)).alias("cells"),
        outliers.alias("outliers"),
        row_identity(df).alias("row"),
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("cells").alias("cells"),
        F.sum("outliers").alias("outliers"),
        F.count_distinct("row").alias("distinct"),
    )

    def percent(part: Column, whole: Column) -> Column:
        return F.round(part / whole * 100.0, 2)

    rows = F.col("rows")
    parts = {
        "completeness": percent(F.col("cells"), rows * len(df.columns)),
        "uniqueness": percent(F.col("distinct"), rows),
        "consistency": F.lit(100.0),
        "freshness": F.lit(100.0),
        "accuracy": F.greatest(
            F.lit(0.0),
            F.round(100.0 - F.col("outliers") / (rows * max(len(numbers), 1)) * 100.0, 2),
        ),
    }
    filled = counts.select(*[
        F.when(rows > 0, p).otherwise(100.0).alias(n) for n, p in parts.items()
    ])
    score = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in K.QUALITY_WEIGHTS.items()])
    scored = filled.select(F.round(score, 1).alias("score"), *parts)
    return scored.withColumn("badge", badge(F.col("score")))


def badge(score: Column) -> Column:
    chain = F
    for below, name in K.QUALITY_BADGES:
        chain = chain.when(score < below, F.lit(name))
    return chain.otherwise(K.QUALITY_TOP_BADGE)
