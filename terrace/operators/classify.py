"""CLASSIFY: word-list sentiment of a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col, option


def classify(df: DataFrame, config: dict) -> DataFrame:
    """Label a text column by how many positive and negative words occur anywhere in it.

    Each word counts once. ``mode`` only names the label column. Without the text column nothing
    changes.
    """
    name = config.get("textColumn")
    if name not in df.columns:
        return df
    target = option(config, "outputColumn", default=f"{config.get('mode', 'sentiment')}_label")
    low, balance = "__low", "__balance"

    def hits(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(low).contains(w).cast("int") for w in words])

    # One projection per stage: lower-casing and counting happen once per row.
    counted = df.withColumn(low, F.lower(col(name).cast("string"))).withColumn(
        balance, hits(K.POSITIVE_WORDS) - hits(K.NEGATIVE_WORDS)
    )
    label = (
        F.when(F.col(balance) > 0, K.POSITIVE)
        .when(F.col(balance) < 0, K.NEGATIVE)
        .otherwise(K.NEUTRAL)
    )
    return counted.withColumn(target, label).drop(low, balance)
