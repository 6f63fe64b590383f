"""TRANSFORM, FILTER, CATEGORIZE and SORT."""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K
from terrace.functions.guard import Refused, check_expression
from terrace.functions.names import as_list, col, option
from terrace.functions.text import to_sql_expression

log = logging.getLogger("terrace")


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Analyse user expressions so that bad values give null instead of failing the job."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def assignments(value, separator: str) -> dict[str, str]:
    """A mapping, or lines of ``name<separator>expression``, as a mapping."""
    if isinstance(value, dict):
        return value
    lines = (line.partition(separator) for line in str(value or "").splitlines())
    return {k.strip(): v.strip() for k, found, v in lines if found and k.strip() and v.strip()}


def user_expression(spark: SparkSession, text: str) -> Column:
    """A user's expression, refused where it does more than compute on the row."""
    return F.expr(check_expression(spark, to_sql_expression(text)))


def transform(df: DataFrame, config: dict) -> DataFrame:
    """Calculated columns, casts, renames and drops. A column that cannot be made is left out."""
    spark = df.sparkSession
    for name, text in assignments(config.get("calculatedColumns"), "=").items():
        try:
            with lenient(spark):
                df = df.withColumn(name, user_expression(spark, text))
        except (PySparkException, Refused) as error:
            log.warning("calculated column %s left out: %s", name, error)
    casts = {n: t for n, t in (config.get("cast") or {}).items() if n in df.columns}
    if casts:
        df = df.withColumns({n: col(n).try_cast(_spark_type(t)) for n, t in casts.items()})
    if config.get("rename"):
        df = df.withColumnsRenamed(config["rename"])
    dropped = [n for n in as_list(config.get("drop")) if n in df.columns]
    return df.drop(*dropped) if dropped else df


def _spark_type(name: str) -> str:
    known = {
        "integer": "bigint", "number": "double", "float": "double", "decimal": "double",
        "varchar": "string", "text": "string", "timestamp": "timestamp_ntz",
        "datetime": "timestamp_ntz",
    }
    return known.get(name.strip().lower(), name)


def filter_rows(df: DataFrame, config: dict) -> DataFrame:
    """Keep rows meeting a condition; ``LIMIT n`` keeps the first n rows of the current order.

    A condition that cannot be understood keeps every row.
    """
    condition = str(option(config, "condition", "filterCondition", default="")).strip()
    if not condition:
        return df
    limit = re.fullmatch(r"limit\s+(\d+)", condition, re.I)
    if limit:
        return df.limit(int(limit.group(1)))
    try:
        with lenient(df.sparkSession):
            return df.filter(user_expression(df.sparkSession, condition))
    except (PySparkException, Refused) as error:
        log.warning("condition %r ignored: %s", condition, error)
        return df


def categorize(df: DataFrame, config: dict) -> DataFrame:
    """Bucket a column. The last matching bucket wins; rows in no bucket are ``Unknown``.

    Buckets are ``{label, min, max}`` with an exclusive upper bound, or ``label: condition`` lines.
    """
    field = option(config, "field", "categorizeField", default="")
    buckets = config.get("categories") or []
    textual = isinstance(buckets, str)
    if field not in df.columns and not (textual and buckets.strip()):
        log.warning("column %r to categorize not found", field)
        return df
    target = option(config, "newColumn", default=f"{field}_tier")
    with lenient(df.sparkSession):
        if textual:
            tests = [
                (label, user_expression(df.sparkSession, test))
                for label, test in assignments(buckets, ":").items()
            ]
        else:
            tests = [_bucket(field, b) for b in buckets]
        tier: Column = F.lit("Unknown")
        if tests:
            (label, test), *rest = reversed(tests)
            chain = F.when(test, F.lit(label))
            for label, test in rest:
                chain = chain.when(test, F.lit(label))
            tier = chain.otherwise(tier)
        return df.withColumn(target, tier)


def _bucket(field: str, bucket: dict) -> tuple[str, Column]:
    low, high = bucket.get("min", -math.inf), bucket.get("max", math.inf)
    label = bucket.get("label", f"{low}-{high}")
    return label, (col(field) >= F.lit(low)) & (col(field) < F.lit(high))


def sort_rows(df: DataFrame, config: dict) -> DataFrame:
    """Order rows, missing values last in both directions.

    A hash of the row breaks ties: the order is repeatable, and a key value that fills a large part
    of the table is spread over several range partitions.
    """
    names = as_list(option(config, "by", "sortField"))
    if not names:
        return df
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"sort columns not found: {', '.join(missing)}")
    ascending = config.get("ascending")
    if ascending is None:
        ascending = str(config.get("sortDirection", "ASC")).upper() != "DESC"
    directions = ascending if isinstance(ascending, list) else [ascending] * len(names)
    if len(directions) != len(names):
        raise ValueError("one direction per sort column is needed")
    keys = [
        F.asc_nulls_last(col(n)) if up else F.desc_nulls_last(col(n))
        for n, up in zip(names, directions, strict=True)
    ]
    return df.orderBy(*keys, tie_break(df))


def tie_break(df: DataFrame) -> Column:
    hashable = [col(f.name) for f in df.schema if not _holds_map(f.dataType)]
    return F.xxhash64(*hashable) if hashable else F.lit(0)


def _holds_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString() or "variant" in dtype.simpleString()


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text, in any letter case, anywhere in any column."""
    if not text:
        return df
    hit = F.lit(False)
    for name in df.columns:
        found = F.lower(col(name).cast("string")).contains(text.lower())
        hit = hit | F.coalesce(found, F.lit(False))
    return df.filter(hit)


def page(df: DataFrame, order: list[Column], number: int = 1, rows: int = K.PAGE_ROWS) -> DataFrame:
    """One page of an ordered frame, counted from 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * rows).limit(rows)
