"""AGGREGATE and PIVOT."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K
from terrace.functions.names import (
    as_list, col, dtype_of, is_float, is_number, option, time_columns,
)
from terrace.functions.numbers import no_nan

log = logging.getLogger("terrace")

_UNITS = {
    "day": "day", "daily": "day", "week": "week", "weekly": "week",
    "month": "month", "monthly": "month",
}


def parse_aggregations(spec) -> list[tuple[str, str, str]]:
    """``(output, function, column)`` triples.

    Takes ``{"output": "column FUNC"}`` or lines of ``output = FUNC(column)``.
    """
    if isinstance(spec, dict):
        pairs = list(spec.items())
    else:
        lines = (line.partition("=") for line in str(spec or "").splitlines())
        pairs = [(out.strip(), text.strip()) for out, eq, text in lines if eq and out.strip()]
    triples = []
    for out, text in pairs:
        call = re.fullmatch(r"(\w+)\s*\((.*)\)", str(text).strip(), re.S)
        words = re.fullmatch(r"(.+?)\s+(\w+)", str(text).strip(), re.S)
        if call:
            triples.append((out, call.group(1).upper(), call.group(2).strip().strip('"')))
        elif words:
            triples.append((out, words.group(2).upper(), words.group(1).strip().strip('"')))
    return triples


def measure(df: DataFrame, function: str, name: str) -> Column:
    """One aggregate with missing values left out and a sum of nothing equal to 0."""
    if function == "COUNT" and name == "*":
        return F.count(F.lit(1))
    dtype = dtype_of(df, name)
    value = no_nan(col(name), dtype)
    if function in ("SUM", "AVG", "AVERAGE") and not is_number(dtype):
        raise ValueError(f"{function} needs a numeric column, {name} is {dtype.simpleString()}")
    if function == "SUM":
        total = F.sum(value)
        zero = F.lit(0.0 if is_float(dtype) else 0)
        return F.coalesce(total, zero if not isinstance(dtype, T.DecimalType) else zero.cast(dtype))
    return {
        "AVG": F.avg, "AVERAGE": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max,
    }[function](value)


def aggregate(df: DataFrame, config: dict) -> DataFrame:
    """Grouped or global aggregates. Rows with a missing group key are left out.

    A group named after a time unit (``month``, ``weekly`` …) that is no column rolls up the date
    column. Unknown functions and columns, and measures their column's type refuses, are skipped; with
    nothing left to compute the input comes back unchanged, or the refusal is raised.
    """
    measures, refused = [], None
    triples = parse_aggregations(option(config, "aggregations", default={}))
    for out, function, name in triples:
        if function not in K.AGGREGATES or not (
            name in df.columns or (name == "*" and function == "COUNT")
        ):
            log.warning("aggregate %s = %s(%s) skipped", out, function, name)
            continue
        try:
            measures.append(measure(df, function, name).alias(out))
        except ValueError as error:
            log.warning("aggregate %s skipped: %s", out, error)
            refused = error
    if refused and not measures:
        raise refused
    if not measures:
        return df
    groups = as_list(config.get("groupBy"))
    if not groups:
        return df.agg(*measures)
    df, keys = _group_keys(df, groups, config)
    if not keys:
        log.warning("none of the group columns %s found", groups)
        return df
    return df.groupBy(*[col(k) for k in keys]).agg(*measures)


def _group_keys(df: DataFrame, groups: list[str], config: dict) -> tuple[DataFrame, list[str]]:
    keys = []
    for name in groups:
        unit = _UNITS.get(name.lower())
        if name not in df.columns and unit:
            date = option(config, "dateColumn", default=next(iter(time_columns(df)), None))
            if date in df.columns:
                df = df.withColumn(name, rollup_key(col(date), unit))
        if name in df.columns:
            keys.append(name)
    for name in keys:
        df = df.filter(col(name).isNotNull())
        if is_float(dtype_of(df, name)):
            df = df.filter(~F.isnan(col(name)))
    return df, keys


def rollup_key(date: Column, unit: str) -> Column:
    """Start of the day, week or month."""
    return F.date_trunc(unit, date).cast("timestamp_ntz")


def pivot(df: DataFrame, config: dict) -> DataFrame:
    """Rows by columns. ``pivotColumnValues`` fixes the columns and saves the job that finds them."""
    rows = as_list(config.get("pivotRows"))
    across = option(config, "pivotColumns")
    name = option(config, "pivotValues")
    needed = [*rows, across, name]
    if not rows or any(n not in df.columns for n in needed):
        raise ValueError(f"pivot columns not found: {needed}")
    function = str(option(config, "aggregation", default="SUM")).upper()
    grouped = df.select(*[col(n) for n in dict.fromkeys(needed)])
    for key in [*rows, across]:
        grouped = grouped.filter(col(key).isNotNull())
    cells = measure(grouped, function, name)
    values = config.get("pivotColumnValues")
    by = grouped.groupBy(*[col(r) for r in rows])
    return by.pivot(across, list(values) if values else None).agg(cells)
