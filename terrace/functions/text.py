"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col, is_text


def strip(value: Column) -> Column:
    """Remove all Unicode whitespace at both ends."""
    return F.btrim(value, F.lit(K.WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once.

    For long chains of patterns. Written out inline, a few such chains in one projection make a
    generated method that takes seconds to compile and is too long for the JVM to optimise.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def is_blank(name: str, dtype) -> Column:
    """True where the column is null or, for text, only whitespace."""
    value = col(name)
    return value.isNull() | (strip(value) == "") if is_text(dtype) else value.isNull()


def template(text: str, columns: list[str]) -> Column:
    """``"REVIEW_{col}"`` as an expression; a brace naming no column stays as it is.

    A null cell is written as ``None``, the way the template language prints missing values.
    """
    pieces = []
    for literal, name in re.findall(r"([^{]+|\{(?!\w+\}))|\{(\w+)\}", text):
        if name in columns:
            pieces.append(F.coalesce(col(name).cast("string"), F.lit("None")))
        else:
            pieces.append(F.lit(literal or "{" + name + "}"))
    return F.concat(*pieces) if pieces else F.lit("")


def split_literals(expression: str) -> list[str]:
    """Cut an expression at its quoted parts; odd positions hold the quoted text."""
    return re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)", expression)


def to_sql_expression(expression: str) -> str:
    """Accept dataframe-style operators in a SQL expression.

    ``&``, ``|``, ``~`` become AND, OR, NOT; list brackets become parentheses; ``!=`` keeps rows
    whose value is missing (``<>`` stays the SQL operator, which drops them).
    """
    parts = split_literals(expression)
    for i in range(0, len(parts), 2):
        text = parts[i]
        text = re.sub(r"&+", " AND ", text)
        text = re.sub(r"(?<!\|)\|(?!\|)", " OR ", text)
        text = re.sub(r"~", " NOT ", text)
        text = re.sub(r"!=", " IS DISTINCT FROM ", text)
        parts[i] = re.sub(r"\bin\s*\[([^\]]*)$", r"in (\1", text.replace("]", ")"), flags=re.I)
        parts[i] = parts[i].replace("[", "(")
    return "".join(parts)
