"""Currency- and locale-aware number parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K
from terrace.functions.names import col, dtype_of, has_word, is_float, is_number
from terrace.functions.text import let, strip

_SPACE = r"[\s\x85\xa0  -     　]*"
# One currency, the digits and marks (captured), one unit, one currency, all of it in brackets or not.
# Possessive, because nothing given back could match later.
_SHAPE = (
    rf"(?i)^\(?{_SPACE}(?:{K.CURRENCIES})?{_SPACE}"
    r"([-+\d.,]++(?:e[-+\d.,]++)?|[-+]?inf(?:inity)?)"
    rf"(?:{_SPACE}(?:{K.UNITS})\.?)?(?:{_SPACE}(?:{K.CURRENCIES}))?{_SPACE}\)?$"
)
_COMMA_IS_POINT = r"\.[^.]*,[^.]*$"


def parse_number(text: Column) -> Column:
    """Text to double; null where the text is no number.

    ``(1.234,50)`` is negative, currencies and units are dropped, and whichever of ``.`` and ``,``
    comes last is the decimal separator when both occur. A lone comma groups thousands, and so do
    dots between groups of three digits. ``1.0d``, which Java would take, is no number.
    """
    return let(strip(text), number_in)


def number_in(value: Column) -> Column:
    """``parse_number`` for text that is already stripped and computed."""
    opens, closes = value.startswith("("), value.endswith(")")
    sign = F.when(opens, F.lit(-1.0)).otherwise(F.lit(1.0))
    # No cast where nothing was captured: a failing cast raises an exception inside, which is slow.
    number = let(
        F.regexp_extract(value, _SHAPE, 1),
        lambda digits: F.when(digits != "", _plain(digits).try_cast("double")),
    )
    return F.when(opens == closes, number * sign)


def _plain(digits: Column) -> Column:
    """The captured part with a point for the decimals and nothing between the thousands."""
    return (
        F.when(digits.rlike(_COMMA_IS_POINT), F.translate(digits, ",.", "."))
        .when(digits.rlike(K.DOT_THOUSANDS), F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(F.replace(digits, F.lit(","), F.lit("")))
    )


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a number: numeric columns as they are, anything else parsed."""
    dtype = dtype_of(df, name)
    if is_number(dtype):
        return no_nan(col(name), dtype)
    return parse_number(col(name).cast("string"))


def as_ledger_number(df: DataFrame, name: str) -> Column:
    """``as_number``, with 0 for missing values in debit and credit columns."""
    number = as_number(df, name)
    if has_word(name, K.LEDGER_WORDS):
        return F.coalesce(number, F.lit(0).cast(number_type(df, name)))
    return number


def number_type(df: DataFrame, name: str) -> T.DataType:
    dtype = dtype_of(df, name)
    return dtype if is_number(dtype) else T.DoubleType()


def no_nan(value: Column, dtype: T.DataType) -> Column:
    """Missing numbers have one form here: NaN becomes null."""
    return F.when(~F.isnan(value), value) if is_float(dtype) else value
