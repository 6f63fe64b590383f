"""JOIN with a stored table, and the row merge behind an upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.names import as_list, col, option

_HOW = {
    "left": "left", "inner": "inner", "right": "right", "outer": "outer", "full": "outer",
}
_LEFT, _RIGHT = "__l_", "__r_"


def join(df: DataFrame, other: DataFrame, config: dict) -> DataFrame:
    """Equi-join in which missing keys match each other.

    Columns both sides have, keys aside, get the suffixes ``_x`` and ``_y``. The key appears once.
    No side is forced to be broadcast; Spark decides from the sizes it knows.
    """
    how = _HOW.get(str(option(config, "type", "joinType", default="left")).strip().lower())
    keys = as_list(option(config, "on", "joinKey", default=df.columns[0]))
    if how is None:
        raise ValueError(f"unknown join type {config.get('type') or config.get('joinType')!r}")
    missing = [k for k in keys if k not in df.columns or k not in other.columns]
    if missing:
        raise ValueError(f"join keys not on both sides: {', '.join(missing)}")

    shared = (set(df.columns) & set(other.columns)) - set(keys)
    left = _prefixed(df, _LEFT)
    right = _prefixed(other, _RIGHT)
    names = [
        *[(n, n) for n in keys],
        *[(_LEFT + n, n + "_x" if n in shared else n) for n in df.columns if n not in keys],
        *[(_RIGHT + n, n + "_y" if n in shared else n) for n in other.columns if n not in keys],
    ]

    def shaped(rows: DataFrame, key_side: str) -> DataFrame:
        present = set(rows.columns)
        out = []
        for source, target in names:
            source = key_side + source if source in keys else source
            value = col(source) if source in present else F.lit(None)
            out.append(value.alias(target))
        return rows.select(*out)

    matches = _match(keys)
    if how in ("left", "inner"):
        return shaped(left.join(right, matches, how), _LEFT)
    # A right or full join cannot be split at a key that is very frequent on the left. So they are put together from an inner
    # or left join and the unmatched rows of the other side, which adaptive execution can all split.
    seen = left.select(*[col(_LEFT + k) for k in keys]).distinct()
    unmatched = right.join(seen, matches, "left_anti")
    found = left.join(right, matches, "inner" if how == "right" else "left")
    return shaped(found, _RIGHT if how == "right" else _LEFT).union(shaped(unmatched, _RIGHT))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[col(n).alias(prefix + n) for n in df.columns])


def _match(keys: list[str]) -> Column:
    pairs = [col(_LEFT + k).eqNullSafe(col(_RIGHT + k)) for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def align_columns(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with the target's spelling of column names that differ only in case."""
    known = {n.lower(): n for n in target.columns}
    return incoming.toDF(*[known.get(n.lower(), n) for n in incoming.columns])


def append_rows(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both; columns only one side has are null on the other."""
    incoming = align_columns(target, incoming)
    return target.unionByName(incoming, allowMissingColumns=True)


def upsert_rows(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Merge incoming rows into a target by key.

    Matched rows take every incoming column, missing values included, and keep columns the batch
    does not have. Unmatched rows are added. Incoming keys must be unique and not null; the writer
    checks that. Without a usable key the rows are appended.
    """
    incoming = align_columns(target, incoming)
    wanted = {k.lower() for k in keys}
    keys = [n for n in incoming.columns if n.lower() in wanted and n in target.columns]
    if not keys:
        return append_rows(target, incoming)
    # A left join and the unmatched rows, not a full join: a small batch is then broadcast without
    # shuffling the target, and a frequent target key can be split.
    batch = _prefixed(incoming, _RIGHT)
    batch_keys = batch.select(*[col(_RIGHT + k) for k in keys])
    target_keys = _prefixed(target.select(*map(col, keys)), _LEFT)
    matched = target_keys.join(batch_keys, _equal(keys), "left_semi").distinct()
    fresh = batch.join(matched, _equal(keys), "left_anti")
    fresh = fresh.toDF(*[n.removeprefix(_RIGHT) for n in fresh.columns])
    if set(incoming.columns) == set(keys):
        return append_rows(target, fresh)

    mark = "__incoming"
    rows = _prefixed(target, _LEFT).join(
        batch.withColumn(mark, F.lit(True)), _equal(keys), "left"
    )
    updated = F.col(mark).isNotNull()
    out = []
    for n in dict.fromkeys([*target.columns, *incoming.columns]):
        if n not in incoming.columns or n in keys:
            value = col(_LEFT + n)
        elif n not in target.columns:
            value = col(_RIGHT + n)
        else:
            value = F.when(updated, col(_RIGHT + n)).otherwise(col(_LEFT + n))
        out.append(value.alias(n))
    return append_rows(rows.select(*out), fresh)


def _equal(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(_LEFT + k) == col(_RIGHT + k) for k in keys])


def repeated_keys(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or are missing, in a batch."""
    missing = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
    return (
        incoming.groupBy(*map(col, keys))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter((F.col("rows") > 1) | missing)
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, as one aggregate with map-side combining.

    The remaining columns break ties, so the result is repeatable.
    """
    rest = [n for n in df.columns if n not in order and n not in keys]
    ranked = F.struct(*[col(n) for n in [*order, *rest]])
    newest = df.groupBy(*map(col, keys)).agg(F.max(ranked).alias("__newest"))
    return newest.select(*[
        col(n) if n in keys else F.col("__newest").getField(n).alias(n) for n in df.columns
    ])
