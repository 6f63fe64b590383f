"""ANOMALY_DETECT: robust z-score and isolation forest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import as_list, dtype_of, is_number, number_columns
from terrace.functions.numbers import as_number
from terrace.operators.quantiles import exact_quantiles
from terrace.session import cut_lineage, spread

TREES = 100
TREE_ROWS = 256
#: Rows let through for each one that a tree takes, on average.
DRAWN = 4


def detect_anomalies(df: DataFrame, config: dict) -> DataFrame:
    """Add an anomaly score in [0, 1] and a label. ``method`` is ``isolation_forest`` or ``zscore``.

    Missing numbers count as the column's median. Without a numeric column every row is normal.
    """
    names = [n for n in as_list(config.get("columns")) if n in df.columns]
    if not as_list(config.get("columns")):
        names = number_columns(df)
    if not names:
        return df.withColumns({K.ANOMALY_SCORE: F.lit(0.0), K.ANOMALY_LABEL: F.lit("NORMAL")})
    textual = [n for n in names if not is_number(dtype_of(df, n))]
    if textual:
        raise ValueError(f"anomaly columns must be numeric: {', '.join(textual)}")
    numbers = {n: as_number(df, n).cast("double") for n in names}
    medians = {n: q.values[0] for n, q in exact_quantiles(df, numbers, [0.5]).items()}
    filled = {
        n: F.coalesce(numbers[n], F.lit(medians[n])) for n in names if medians[n] is not None
    }
    if str(config.get("method", "isolation_forest")).lower() == "zscore":
        return _by_zscore(df, filled)
    return _by_forest(df, filled, int(config.get("seed", 42)))


def _by_zscore(df: DataFrame, filled: dict[str, Column]) -> DataFrame:
    measures = [
        m for i, v in enumerate(filled.values())
        for m in (F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"))
    ]
    row = df.agg(*measures).first() if measures else None
    scores = [F.lit(0.0), F.lit(0.0)]
    for i, v in enumerate(filled.values()):
        if (row[f"std{i}"] or 0) > 0:
            scores.append(F.abs(v - row[f"mean{i}"]) / row[f"std{i}"])
    share = F.least(F.greatest(*scores) / K.ZSCORE_THRESHOLD, F.lit(1.0))
    label = (
        F.when(share > K.ANOMALY_ABOVE, "ANOMALY")
        .when(share > K.SUSPICIOUS_ABOVE, "SUSPICIOUS")
        .otherwise("NORMAL")
    )
    return df.withColumns({K.ANOMALY_SCORE: F.round(share, 4), K.ANOMALY_LABEL: label})


def _by_forest(df: DataFrame, filled: dict[str, Column], seed: int) -> DataFrame:
    """Isolation forest (Liu, Ting and Zhou, 2008).

    Trees grow in parallel, one per group, from small samples; the forest is a fixed number of
    short arrays. Scoring reads only the feature columns into Python.
    """
    features = [v.alias(f"f{i}") for i, v in enumerate(filled.values())]
    if not features:
        return df.withColumns({K.ANOMALY_SCORE: F.lit(0.0), K.ANOMALY_LABEL: F.lit("NORMAL")})
    total = df.count()
    forest = _grow(df.select(*features), total, seed)
    score = _scorer(forest, min(TREE_ROWS, total))(*features)
    # Scores are read several times for the threshold: keep that one column, not the table.
    inputs = spread(df.select(*features))
    raw_score = _scorer(forest, min(TREE_ROWS, total))(*[F.col(n) for n in inputs.columns])
    scores = cut_lineage(inputs.select(raw_score.alias("score")))
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    limit = exact_quantiles(scores, {"score": F.col("score")}, [1 - K.CONTAMINATION])
    limit = limit["score"].values[0]
    low, high = ends.low or 0.0, ends.high or 0.0
    width = F.lit(high - low + 1e-6)
    scored = df.withColumn(K.ANOMALY_SCORE, score)
    raw = F.col(K.ANOMALY_SCORE)
    return scored.withColumns({
        K.ANOMALY_LABEL: F.when(raw > F.lit(limit), "ANOMALY").otherwise("NORMAL"),
        K.ANOMALY_SCORE: F.round((raw - low) / width, 4) if high > low else F.lit(0.0),
    })


def _grow(features: DataFrame, total: int, seed: int) -> list[dict]:
    """Grow each tree on the executors from the rows with the least hashes for that tree.

    Every row has a place in [0, 1) for each tree. The cut lets through some ``DRAWN`` times the rows that a tree needs, so that no group
    grows with the table; the tree takes the least of those. A table with fewer rows than that is let through whole.
    """
    cut = min(1.0, DRAWN * TREE_ROWS / max(total, 1))
    every = F.sequence(F.lit(0), F.lit(TREES - 1))
    place = lambda t: F.shiftrightunsigned(F.xxhash64(F.col("__draw"), t), 11) / F.lit(2.0**53)
    places = F.transform(every, lambda t: F.struct(t.alias("tree"), place(t).alias("place")))
    drawn = features.withColumn("__draw", F.rand(seed)).select(
        F.inline(F.filter(places, lambda p: p["place"] < cut)), *features.columns)
    names = features.columns
    rows_per_tree = TREE_ROWS

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np

        rng = np.random.default_rng(seed + int(key[0]))
        data = rows.nsmallest(rows_per_tree, "place")[names].to_numpy(dtype=float)
        depth = math.ceil(math.log2(max(len(data), 2)))
        nodes = {k: [] for k in ("feature", "cut", "left", "right", "size", "depth")}

        def add(part, level):
            at = len(nodes["size"])
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            leaf = level >= depth or len(part) <= 1 or len(usable) == 0
            f = -1 if leaf else int(rng.choice(usable))
            cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
            for k, v in zip(nodes, (f, cut, -1, -1, len(part), level), strict=True):
                nodes[k].append(v)
            if not leaf:
                below = part[:, f] < cut
                nodes["left"][at] = add(part[below], level + 1)
                nodes["right"][at] = add(part[~below], level + 1)
            return at

        if len(data):
            add(data, 0)
        return pd.DataFrame({"tree": [int(key[0])], **{k: [v] for k, v in nodes.items()}})

    schema = (
        "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
        "size array<int>, depth array<int>"
    )
    grown = drawn.groupBy("tree").applyInPandas(grow, schema).collect()
    return [r.asDict() for r in sorted(grown, key=lambda r: r.tree)]


def _scorer(forest: list[dict], rows: int):
    """A column function: average path length over the trees, turned into a score in (0, 1)."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        import numpy as np

        def unbuilt(n):
            n = np.asarray(n, dtype=float)
            big = np.where(n > 2, n, 3.0)
            path = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
            return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))

        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        every = np.arange(len(data))
        total = np.zeros(len(data))
        for tree in forest:
            feature, cut, left, right, size, depth = (
                np.asarray(tree[k]) for k in ("feature", "cut", "left", "right", "size", "depth")
            )
            at = np.zeros(len(data), dtype=int)
            for _ in range(int(depth.max())):
                f = feature[at]
                below = data[every, np.maximum(f, 0)] < cut[at]
                at = np.where(f < 0, at, np.where(below, left[at], right[at]))
            total += depth[at] + unbuilt(size[at])
        usual = float(unbuilt(rows)) or 1.0
        return pd.Series(np.exp2(-total / max(len(forest), 1) / usual))

    return score
