"""FORECAST: linear trend over the time order of a measure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K
from terrace.functions.dates import parse_date
from terrace.functions.names import (
    col, dtype_of, is_text, is_time, number_columns, option, time_columns,
)
from terrace.functions.numbers import as_number
from terrace.session import cut_lineage


def forecast(df: DataFrame, config: dict) -> DataFrame:
    """The input rows, followed by daily future rows with the trend and its band.

    With fewer than three points, or without a date and a measure, the input comes back unchanged.
    """
    date = option(config, "dateColumn")
    target = option(config, "targetColumn")
    horizon = int(option(config, "horizon", default=K.FORECAST_HORIZON))
    if date not in df.columns:
        date = next(iter(time_columns(df)), None)
    if target not in df.columns:
        target = next(iter(number_columns(df)), None)
    if date is None or target is None:
        return df
    if not is_time(dtype_of(df, date)):
        if not is_text(dtype_of(df, date)):
            raise ValueError(f"{date} is neither a date nor text")
        history = df.withColumn(date, parse_date(col(date)))
    else:
        history = df
    points = history.select(
        col(date).alias("at"), as_number(df, target).cast("double").alias("y")
    ).filter("at is not null and y is not null")
    trend = fit_trend(points)
    if trend is None:
        return df
    count, last, slope, intercept, error = trend
    steps = df.sparkSession.range(1, horizon + 1)
    expected = F.lit(intercept) + F.lit(slope) * (F.lit(count - 1) + F.col("id"))
    future = steps.select(
        _days_after(last, dtype_of(history, date)).alias(date),
        F.round(expected, 2).alias(f"{target}_forecast"),
        F.round(expected - K.FORECAST_BAND * error, 2).alias(f"{target}_lower"),
        F.round(expected + K.FORECAST_BAND * error, 2).alias(f"{target}_upper"),
    )
    return history.unionByName(future, allowMissingColumns=True)


def _days_after(last, dtype: T.DataType) -> Column:
    day = F.col("id").cast("int")
    if isinstance(dtype, T.DateType):
        return F.date_add(F.lit(last), day)
    return F.lit(last).cast(dtype) + F.make_dt_interval(days=day)


def fit_trend(points: DataFrame):
    """Least-squares line of ``y`` over the rank of ``at``; ties in time are ranked by ``y``.

    Returns (points, last time, slope, intercept, residual deviation), or None below three points.

    Ranking does not bring the rows together in one task: equal points are counted first, the
    counts are range-partitioned, and each partition starts at the total of those before it. The
    partition numbers are stored with the rows, so both uses of them agree.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut_lineage(
        points.groupBy("at", "y")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange(tasks, "at", "y")
        .withColumn("part", F.spark_partition_id())
    )
    sums = blocks.agg(
        F.sum("n").alias("n"),
        F.max("at").alias("last"),
        (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean"),
    ).first()
    count = sums.n or 0
    if count < K.FORECAST_MIN_POINTS:
        return None

    # One row per partition, so a single window and a broadcast are bounded.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.sum("n").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    within = (
        Window.partitionBy("part").orderBy("at", "y").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = blocks.join(F.broadcast(starts), "part").select(
        "n",
        (F.col("y") - sums["mean"]).alias("y"),
        # Mean rank of the block, measured from the middle of the series.
        (
            F.col("start")
            + F.coalesce(F.sum("n").over(within), F.lit(0))
            + (F.col("n") - 1) / 2.0
            - (count - 1) / 2.0
        ).alias("x"),
    )
    moments = ranked.agg(
        F.sum(F.col("n") * F.col("x") * F.col("y")).alias("xy"),
        F.sum(F.col("n") * F.col("y") * F.col("y")).alias("yy"),
    ).first()
    xx = count * (count * count - 1) / 12
    slope = moments.xy / xx
    rest = moments.yy - slope * moments.xy
    error = math.sqrt(rest / count) if rest > 1e-12 * moments.yy else 0.0
    return count, sums["last"], slope, sums["mean"] - slope * (count - 1) / 2, error
