"""Exports, written in parallel by Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col
from terrace.operators.bi import widget


_SPACE_KEPT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_table(df: DataFrame, path: str, fmt: str = "csv", limit: int | None = K.EXPORT_ROWS) -> None:
    """A table as CSV or TSV with every field quoted and missing values empty, or as JSON.

    The first ``limit`` rows are written; without a limit, all of them, in parallel.
    """
    rows = df if limit is None else df.limit(limit)
    fmt = fmt.lower()
    if fmt == "json":
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unknown export format {fmt!r}")
    # White space in cells is part of them; Spark's writer would trim it.
    texts = rows.select(*[
        F.coalesce(col(n).cast("string"), F.lit("")).alias(n) for n in rows.columns
    ])
    (
        texts.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .options(**_SPACE_KEPT)
        .option("sep", "\t" if fmt == "tsv" else ",")
        .csv(path)
    )


def archive(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def export_dashboard(tables: dict[str, DataFrame], widgets: list[dict], path: str) -> list[str]:
    """One CSV folder per widget: its KPI value, or the rows of its table.

    A widget whose source is missing is left out. Returns the folders written.
    """
    written = []
    for number, cfg in enumerate(widgets):
        source = cfg.get("dataSource") or f"{cfg.get('layer')}/{cfg.get('table')}"
        df = tables.get(source)
        if df is None:
            continue
        is_kpi = str(cfg.get("type", "")).upper() == "KPI"
        rows = widget(df, cfg) if is_kpi else df.limit(K.SHARED_TABLE_ROWS)
        title = re.sub(r"\W+", "_", str(cfg.get("title", "widget"))).strip("_").lower()
        folder = f"{path.rstrip('/')}/{number:02d}_{title}"
        rows.write.mode("overwrite").option("header", True).option("escape", '"').options(**_SPACE_KEPT).csv(folder)
        written.append(folder)
    return written
