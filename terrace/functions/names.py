"""Plan-time decisions about column names, identifiers and types. Nothing here touches data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import constants as K


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_word(name: str, words: Iterable[str]) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def _squeeze(name: str) -> str:
    return re.sub(r"[ _]", "", name.lower()).strip()


def resolve_column(columns: Sequence[str], wanted: str | None) -> str | None:
    """Find a column: exactly, then ignoring case, spaces and underscores, then by substring."""
    if not wanted:
        return None
    key = _squeeze(wanted)
    ways = (
        lambda c: c == wanted,
        lambda c: _squeeze(c) == key,
        lambda c: key in c.lower() or c.lower() in key,
    )
    for matches in ways:
        hit = next((c for c in columns if matches(c)), None)
        if hit is not None:
            return hit
    return None


def check_layer(layer: str) -> str:
    name = layer.strip().lower() if isinstance(layer, str) else layer
    if name not in K.LAYERS:
        raise ValueError(f"unknown layer {layer!r}; expected one of {', '.join(K.LAYERS)}")
    return name


def safe_identifier(name: str) -> str:
    """Table or column name with every character outside word, dash and dot made an underscore."""
    if not name:
        raise ValueError("an identifier must not be empty")
    return re.sub(r"[^\w\-.]", "_", name)


def strict_identifier(name: str) -> str:
    """Accept a plain identifier, reject anything else."""
    text = name.strip() if isinstance(name, str) else ""
    if not re.fullmatch(r"(?!\d)[A-Za-z0-9_-]+", text):
        raise ValueError(f"invalid identifier {name!r}")
    return text


def record_column(key: str) -> str:
    """Column name for a record key of a landed JSON payload."""
    text = "".join(ch if ch.isalnum() else "_" for ch in key).lower().strip("_")
    if not text:
        return "col"
    return "col_" + text if text[0].isdigit() else text


def unique_names(names: Sequence[str]) -> list[str]:
    """Make repeated names distinct with ``.1``, ``.2`` … suffixes, keeping first occurrences."""
    seen: dict[str, int] = {}
    taken = set(names)
    out = []
    for name in names:
        n = seen.get(name, 0)
        fresh = name
        while n and fresh in taken:
            fresh, n = f"{name}.{n}", n + 1
        seen[name] = max(n, 1)
        taken.add(fresh)
        out.append(fresh)
    return out


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_time(f.dataType)]


def logical_type(dtype: T.DataType) -> str:
    """Type label used in table metadata."""
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if is_number(dtype):
        return "DECIMAL"
    if is_time(dtype):
        return "TIMESTAMP"
    return "BOOLEAN" if isinstance(dtype, T.BooleanType) else "VARCHAR"


def column_role(name: str, dtype: T.DataType) -> str:
    """Role of a column in an automatic dashboard: categorical, numeric, date or text."""
    low = name.lower()
    if has_word(name, K.CATEGORY_WORDS) or any(re.search(p, low) for p in K.CATEGORY_PATTERNS):
        return "categorical"
    if is_number(dtype):
        return "numeric"
    return "date" if is_time(dtype) else "text"


def pii_kind(name: str) -> str | None:
    """Kind of personal data a column holds, judged by its name."""
    low = re.sub(r"[^a-z0-9]", "", name.lower())
    return next((kind for kind, words in K.PII_WORDS if any(w in low for w in words)), None)


def as_list(value) -> list[str]:
    """A comma-separated string or a list of names, as a list of trimmed names."""
    parts = value.split(",") if isinstance(value, str) else (value or [])
    return [str(p).strip() for p in parts if str(p).strip()]


def option(config: dict, *keys: str, default=None):
    """First non-empty value among several spellings of one option."""
    for key in keys:
        if config.get(key) not in (None, ""):
            return config[key]
    return default
