"""CLEAN: whitespace, automatic typing, duplicates, missing values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K
from terrace.functions.dates import date_in, parse_date
from terrace.functions.names import col, dtype_of, has_word, is_number, is_text, text_columns
from terrace.functions.numbers import as_ledger_number, number_in
from terrace.functions.text import let, strip, template
from terrace.session import spread


_PRESENT, _NUMBER, _SHAPED, _DATE = 1, 2, 4, 8
_NULL_LIKE = "(?i)^(?:" + "|".join(K.NULL_LIKE) + ")$"


def clean(df: DataFrame, config: dict) -> DataFrame:
    if config.get("stripWhitespace"):
        df = strip_whitespace(df)
    if config.get("autoTypeInference", True):
        df = infer_types(df)
    if config.get("deduplicate"):
        df = df.dropDuplicates()
    return fill_nulls(df, config.get("fillNulls"), config.get("fillNullsValue", ""))


def strip_whitespace(df: DataFrame) -> DataFrame:
    return df.withColumns({n: strip(col(n)) for n in text_columns(df)})


def type_profile(df: DataFrame, names: list[str]) -> dict[str, dict[str, int]]:
    """Counts that decide the type of each text column, all columns in one pass.

    Each cell becomes one small number that says what it could be; those are counted.
    """

    def reading(value: Column) -> Column:
        shaped = (
            value.rlike(K.DATE_SHAPE)
            & (F.length(value) >= K.DATE_SHAPE_LENGTH)
            & ~value.rlike(r"^\d+$")
        )
        number = F.when(number_in(value).isNotNull(), _NUMBER).otherwise(0)
        date = F.when(date_in(value).isNotNull(), _SHAPED + _DATE).otherwise(_SHAPED)
        missing = value.isNull() | value.rlike(_NULL_LIKE)
        return F.when(missing, 0).otherwise(number + F.when(shaped, date).otherwise(0) + _PRESENT)

    readings = spread(df.select(*map(col, names))).select(*[
        let(strip(col(n)), reading).alias(f"r{i}") for i, n in enumerate(names)
    ])
    bits = {"values": _PRESENT, "numbers": _NUMBER, "shaped": _SHAPED, "dates": _DATE}
    row = readings.agg(*[
        F.count_if(F.col(r).bitwiseAND(bit) > 0).alias(f"{key}_{r}")
        for r in readings.columns for key, bit in bits.items()
    ]).first()
    return {n: {k: row[f"{k}_r{i}"] for k in bits} for i, n in enumerate(names)}


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the type most of their values have.

    The profile covers the whole column, so the outcome does not depend on row order. Columns
    without any value are typed by their name. Columns starting with ``_`` are left alone.
    """
    names = [n for n in text_columns(df) if not n.startswith("_")]
    if not names:
        return df
    typed: dict[str, Column] = {}
    for name, n in type_profile(df, names).items():
        total = n["values"]
        if total == 0:
            if has_word(name, K.MONEY_WORDS):
                typed[name] = F.lit(None).cast("double")
            elif has_word(name, K.DATE_WORDS):
                typed[name] = F.lit(None).cast("timestamp_ntz")
        elif n["numbers"] / total >= K.NUMERIC_RATIO:
            typed[name] = as_ledger_number(df, name)
        elif (
            n["shaped"] / total >= K.DATE_SHAPE_RATIO
            and n["dates"] / total >= K.DATE_PARSE_RATIO
        ):
            typed[name] = parse_date(col(name))
    return df.withColumns(typed) if typed else df


def fill_nulls(df: DataFrame, fill, value="") -> DataFrame:
    """Fill missing cells: one value for all text columns, or a value per column.

    A value may be a template such as ``"REVIEW_{id}"``. A column map may be given as JSON text.
    """
    if isinstance(fill, str) and fill.strip().startswith("{"):
        try:
            fill = json.loads(fill)
        except ValueError:
            return df
    if not fill:
        return df
    if fill is True:
        values = {n: str(value) for n in text_columns(df)}
    elif isinstance(fill, dict):
        values = {n: str(v) for n, v in fill.items() if n in df.columns}
    else:
        return df
    filled = {n: _filled(df, n, v) for n, v in values.items()}
    return df.withColumns(filled) if filled else df


def _filled(df: DataFrame, name: str, value: str) -> Column:
    dtype = dtype_of(df, name)
    if is_text(dtype):
        return F.coalesce(col(name), template(value, df.columns))
    if is_number(dtype) and _is_python_number(value):
        fits = isinstance(dtype, T.IntegralType) and float(value).is_integer()
        target = dtype if fits or not isinstance(dtype, T.IntegralType) else T.DoubleType()
        return F.coalesce(col(name).cast(target), F.lit(float(value)).cast(target))
    return F.coalesce(col(name).cast("string"), template(value, df.columns))


def _is_python_number(value: str) -> bool:
    try:
        float(value)
    except ValueError:
        return False
    return True
