"""A flow: ordered steps folded over one lazy DataFrame, with outputs along the way."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.names import check_layer, logical_type, option, safe_identifier
from terrace.operators.aggregate import aggregate, pivot
from terrace.operators.anomaly import detect_anomalies
from terrace.operators.classify import classify
from terrace.operators.clean import clean
from terrace.operators.forecast import forecast
from terrace.operators.insight import narratives
from terrace.operators.join import join
from terrace.operators.transform import categorize, filter_rows, sort_rows, transform
from terrace.operators.validate import drops_rows, quarantine_record, split_valid, validate
from terrace.sources.files import read_csv
from terrace.sources.lake import Lake, harden_types

log = logging.getLogger("terrace")

STEPS = {
    "CLEAN": clean,
    "VALIDATE": validate,
    "TRANSFORM": transform,
    "FILTER": filter_rows,
    "CATEGORIZE": categorize,
    "AGGREGATE": aggregate,
    "PIVOT": pivot,
    "SORT": sort_rows,
    "ANOMALY_DETECT": detect_anomalies,
    "FORECAST": forecast,
    "CLASSIFY": classify,
}
_SUMMARISING = {"AGGREGATE", "JOIN", "PIVOT"}


def step_config(step: dict) -> dict:
    config = step.get("config") or {}
    return dict(json.loads(config) if isinstance(config, str) else config)


def ordered(steps: list[dict]) -> list[dict]:
    return sorted(steps, key=lambda s: s.get("order", 0))


def check_gold(steps: list[dict]) -> None:
    """A gold table must be summarised: an AGGREGATE, JOIN or PIVOT comes before its OUTPUT."""
    summarised = False
    for step in ordered(steps):
        kind = step.get("type")
        summarised |= kind in _SUMMARISING
        if kind == "OUTPUT" and _target(step)[0] == "gold" and not summarised:
            raise ValueError("output to the gold layer needs an AGGREGATE, JOIN or PIVOT before it")


def _target(step: dict) -> tuple[str, str]:
    config = step_config(step)
    layer = option(step, "outputLayer", default=option(config, "outputLayer", "layer"))
    table = option(step, "outputTable", default=option(config, "outputTable", "tableName"))
    return check_layer(layer or "SILVER"), safe_identifier(table or "output").lower()


def apply_steps(df: DataFrame, steps: list[dict], lookup=None, errors: list | None = None) -> DataFrame:
    """Fold transforming steps over a frame; a step that fails is noted and passed over.

    Names and expressions are checked while the plan is built, so that is where steps fail.
    ``lookup`` finds the table a JOIN names.
    """
    for number, step in enumerate(ordered(steps), 1):
        df = _apply(df, number, step, lookup, errors if errors is not None else [])
    return df


def _apply(df: DataFrame, number: int, step: dict, lookup, errors: list) -> DataFrame:
    kind, config = step.get("type", "UNKNOWN"), step_config(step)
    try:
        if kind == "JOIN":
            source = option(config, "source", "joinSource")
            return join(df, lookup(source), config) if source else df
        if kind in STEPS:
            return STEPS[kind](df, config)
    except (PySparkException, ValueError, TypeError) as error:
        log.warning("step %d (%s) passed over: %s", number, kind, error)
        errors.append({"step": number, "type": kind, "error": str(error)})
        return df
    log.warning("step %d has the unknown type %s", number, kind)
    return df


def load_source(lake: Lake, config: dict, source: dict) -> DataFrame:
    """The frame a SOURCE step names: a lakehouse table, or a delimited file."""
    if source.get("fromLakehouse") or source.get("sourceTable") or config.get("sourceTable"):
        table = option(source, "sourceTable", default=config.get("sourceTable"))
        layer = option(source, "sourceLayer", default=config.get("sourceLayer") or "BRONZE")
        return lake.read(layer, table)
    path = option(config, "filePath", default=source.get("filePath"))
    if not path:
        raise ValueError("the source names neither a table nor a file")
    return read_csv(lake.spark, path, bool(config.get("multiLine")))


def run(lake: Lake, spec: dict, frame: DataFrame | None = None, as_of: datetime | None = None) -> dict:
    """Run a flow and return its summary: rows, columns, outputs, insights and step errors.

    ``frame`` stands in for the SOURCE step. Failing transforms are noted and passed over; failing
    sources and outputs end the run.
    """
    steps = ordered(spec.get("steps", []))
    check_gold(steps)
    source = spec.get("source") or {}
    context = {"run_id": spec.get("runId", 0), "pipeline_id": spec.get("pipelineId", 0)}
    as_of = as_of or datetime.now(UTC)
    outputs_left = sum(s.get("type") == "OUTPUT" for s in steps)
    df, was_sorted = frame, False
    summary: dict = {"rows": 0, "columns": [], "outputs": []}
    errors: list[dict] = []
    summarised = False
    for number, step in enumerate(steps, 1):
        kind, config = step.get("type", "UNKNOWN"), step_config(step)
        if kind == "OUTPUT" and df is not None and _target(step)[0] == "gold" and not summarised:
            raise ValueError(f"no gold table: the summarising step before it failed: {errors}")
        if kind == "SOURCE":
            df = frame if frame is not None else load_source(lake, config, source)
        elif df is None:
            log.warning("step %d (%s) has no data", number, kind)
        elif kind == "OUTPUT":
            outputs_left -= 1
            layer, table = _target(step)
            mode = str(option(step, "writeMode", default=config.get("writeMode") or "overwrite"))
            keys = option(step, "primaryKey", default=config.get("primaryKey"))
            rows = lake.write(df, layer, table, mode, keys, context, as_of)
            columns = [{"name": f.name, "type": logical_type(f.dataType)} for f in df.schema]
            summary["outputs"].append(
                {"layer": layer, "table": table, "rows": rows, "columns": columns}
            )
            summary |= {"rows": rows, "columns": columns}
            if outputs_left and not was_sorted and mode.lower() == "overwrite":
                df = _continue_from(lake, df, layer, table)
        elif kind == "INSIGHT":
            summary["insights"] = narratives(df)
        elif kind == "VALIDATE":
            config["_source_category"] = source.get("category")
            checked = {**step, "config": config}
            if drops_rows(config):
                df = _validate_and_drop(lake, df, number, checked, context, as_of, errors)
            else:
                df = _apply(df, number, checked, None, errors)
        else:
            was_sorted = kind == "SORT" or (was_sorted and kind not in _SUMMARISING)
            before = df
            df = _apply(df, number, step, lake.find, errors)
            summarised |= kind in _SUMMARISING and df is not before
    lake.register(summary["outputs"], as_of)
    if errors:
        summary["step_errors"] = errors
    return summary


def _continue_from(lake: Lake, df: DataFrame, layer: str, table: str) -> DataFrame:
    """Go on from the rows just written, so that later outputs do not compute them again.

    Only where writing changed neither names nor types.
    """
    if harden_types(df).schema != df.schema or any(n in K.LINEAGE for n in df.columns):
        return df
    written = lake.read(layer, table)
    if not set(df.columns) <= set(written.columns):
        return df
    return written.select(*[F.col(f"`{n}`") for n in df.columns])


def quarantine_table(pipeline_id: int, step: int) -> str:
    """Table in the silver layer with the rows a dropping VALIDATE step last took out."""
    return f"{K.FAILED_ROWS_TABLE}_{pipeline_id}_{step}"


def _validate_and_drop(lake, df, number, step, context, as_of, errors) -> DataFrame:
    """Keep the rows that pass; the others go to the step's quarantine table, with a record of them."""
    try:
        kept, rejected = split_valid(df, step_config(step))
    except (PySparkException, ValueError, TypeError) as error:
        errors.append({"step": number, "type": "VALIDATE", "error": str(error)})
        return df
    table = quarantine_table(context["pipeline_id"], number)
    count = lake.overwrite(rejected, "silver", table)
    if count:
        record = quarantine_record(
            lake.read("silver", table), count, "Validation rules dropped rows", F.lit(as_of)
        )
        lake.append(record, "silver", K.FAILED_ROWS_TABLE)
    return kept
