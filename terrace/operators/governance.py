"""Masking of personal data, platform metrics and audit queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import col, pii_kind
from terrace.functions.text import strip

# --- masking ---------------------------------------------------------------------------------------


def mask_email(text: Column) -> Column:
    parts = F.split(text, "@")
    user, domain = parts[0], parts[1]
    size = F.length(user)
    hidden = F.when(size <= 2, F.concat(F.substring(user, 1, 1), F.lit("*"))).otherwise(
        F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), size - 2), F.right(user, F.lit(1)))
    )
    return F.when(text.contains("@"), F.concat(hidden, F.lit("@"), domain)).otherwise(text)


def mask_phone(text: Column) -> Column:
    bare = strip(text)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(bare) - 8))
    masked = F.concat(F.substring(bare, 1, 4), stars, F.right(bare, F.lit(4)))
    return F.when(F.length(bare) < 7, bare).otherwise(masked)


def mask_national_id(text: Column) -> Column:
    bare = strip(text)
    masked = F.concat(F.substring(bare, 1, 4), F.repeat(F.lit("*"), F.length(bare) - 4))
    return F.when(F.length(bare) < 10, bare).otherwise(masked)


def mask_card(text: Column) -> Column:
    digits = F.regexp_replace(text, r"(?U)[\s-]", "")
    masked = F.concat(F.substring(digits, 1, 4), F.lit("-****-****-"), F.right(digits, F.lit(4)))
    return F.when(F.length(digits) < 12, text).otherwise(masked)


_MASKS = {"EMAIL": mask_email, "PHONE": mask_phone, "NIK": mask_national_id, "CARD": mask_card}


def mask_dataset(df: DataFrame) -> DataFrame:
    """Mask every column whose name tells of personal data. Nulls and other columns stay."""
    masked = {
        n: _MASKS[kind](col(n).cast("string")) for n in df.columns if (kind := pii_kind(n))
    }
    return df.withColumns(masked) if masked else df


# --- metrics -----------------------------------------------------------------------------------------

METRICS = (
    "TOTAL_DATA_SOURCES",
    "ACTIVE_PIPELINES",
    "PIPELINE_SUCCESS_RATE",
    "TOTAL_ROWS_PROCESSED",
    "AVG_PIPELINE_DURATION",
    "FAILED_PIPELINE_RUNS",
    "TOTAL_AUDIT_EVENTS",
)


def metrics(
    sources: DataFrame,
    pipelines: DataFrame,
    runs: DataFrame,
    audits: DataFrame,
    tenant: int | None = None,
) -> DataFrame:
    """All platform metrics as ``(metric, value)``, with one aggregate per table.

    The tenant narrows sources, pipelines and audit events; runs belong to the whole platform.
    """

    def own(df: DataFrame) -> DataFrame:
        return df.filter(F.col("tenantId") == tenant) if tenant else df

    every = F.count(F.lit(1))
    success = F.col("status") == "SUCCESS"
    duration = F.coalesce(F.avg(F.when(success, F.col("duration"))), F.lit(0.0))
    tables = (
        (own(sources), {"TOTAL_DATA_SOURCES": every}),
        (own(pipelines), {"ACTIVE_PIPELINES": F.count_if(F.col("status") == "ACTIVE")}),
        (runs, {
            "PIPELINE_SUCCESS_RATE": F.when(every == 0, 100).otherwise(
                _half_up(F.count_if(success) / F.greatest(every, F.lit(1)) * 100)
            ),
            "TOTAL_ROWS_PROCESSED": F.coalesce(F.sum("rowsOutput"), F.lit(0)),
            "AVG_PIPELINE_DURATION": _half_up(duration),
            "FAILED_PIPELINE_RUNS": F.count_if(F.col("status") == "FAILED"),
        }),
        (own(audits), {"TOTAL_AUDIT_EVENTS": every}),
    )
    return reduce(DataFrame.unionAll, [_as_rows(df, values) for df, values in tables])


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def _as_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values
    ]
    row = df.agg(*[v.cast("bigint").alias(n) for n, v in values.items()])
    return row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def metric(name: str, *tables: DataFrame, tenant: int | None = None) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"metric {name!r} is not defined")
    return metrics(*tables, tenant=tenant).filter(F.col("metric") == name)


# --- audit log and overview ----------------------------------------------------------------------------


def audit_filter(df: DataFrame, tenant=None, action=None, resource=None) -> DataFrame:
    for name, value in (("tenantId", tenant), ("action", action), ("resource", resource)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def audit_events(
    df: DataFrame, tenant=None, action=None, resource=None, limit: int = K.AUDIT_ROWS,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The newest events that meet the filters, and how many meet them in all."""
    events = audit_filter(df, tenant, action, resource)
    ordered = events.orderBy(F.desc("createdAt"), F.desc("id"))
    return ordered.offset(offset).limit(limit), events.agg(F.count(F.lit(1)).alias("total"))


def layer_counts(catalog: DataFrame) -> DataFrame:
    """Number of tables in each layer, layers without tables included."""
    row = catalog.agg(*[F.count_if(F.lower("layer") == n).alias(n) for n in K.LAYERS])
    cells = [F.struct(F.lit(n).alias("layer"), F.col(n).alias("tables")) for n in K.LAYERS]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def most_recent(df: DataFrame, order: str, rows: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(col(order)), *map(col, df.columns)).limit(rows)
