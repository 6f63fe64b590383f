"""Dashboard queries: filters, KPI cards, grouped charts, automatic dashboards, guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.guard import check_query
from terrace.functions.names import col, column_role, dtype_of, is_number, is_text, option
from terrace.operators.transform import tie_break

CARD_AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")


# --- filters -----------------------------------------------------------------------------------


def _value(df: DataFrame, name: str, value) -> Column:
    """A filter value in the type of its column, so that the comparison reaches the scan."""
    dtype = dtype_of(df, name)
    text = F.lit(str(value))
    return text if is_text(dtype) else text.try_cast(dtype)


def filter_predicates(df: DataFrame, filters: list[dict] | None) -> list[Column]:
    """One predicate per usable filter. Bounds of GREATER_THAN and LESS_THAN are inclusive."""
    predicates = []
    for f in filters or []:
        name = re.sub(r"[^A-Za-z0-9_.]", "", f.get("field") or "")
        value, kind = f.get("value"), f.get("operator")
        if not name or value is None or value == "":
            continue
        if kind == "EQUALS":
            predicates.append(col(name) == _value(df, name, value))
        elif kind == "NOT_EQUALS":
            predicates.append(col(name) != _value(df, name, value))
        elif kind == "GREATER_THAN":
            predicates.append(col(name) >= _value(df, name, value))
        elif kind == "LESS_THAN":
            predicates.append(col(name) <= _value(df, name, value))
        elif kind == "BETWEEN" and isinstance(value, (list, tuple)) and len(value) == 2:
            predicates.append(col(name).between(*[_value(df, name, v) for v in value]))
        elif kind == "IN" and isinstance(value, (list, tuple)) and value:
            predicates.append(col(name).isin(*[_value(df, name, v) for v in value]))
        elif kind == "CONTAINS":
            predicates.append(col(name).cast("string").ilike(f"%{value}%"))
    return predicates


def apply_filters(df: DataFrame, filters: list[dict] | None) -> DataFrame:
    for predicate in filter_predicates(df, filters):
        df = df.filter(predicate)
    return df


def _widget_condition(df: DataFrame, cfg: dict) -> Column | None:
    """``filterField = filterValue``; a value that looks like a number is compared as one."""
    name, value = cfg.get("filterField"), cfg.get("filterValue")
    if not name or value in (None, ""):
        return None
    numeric = re.fullmatch(r"-?\d+(\.\d+)?", str(value)) and not is_text(dtype_of(df, name))
    if numeric:
        return col(name) == F.lit(float(value) if "." in str(value) else int(value))
    return col(name) == _value(df, name, value)


def _widget_filter(df: DataFrame, cfg: dict) -> DataFrame:
    condition = _widget_condition(df, cfg)
    return df if condition is None else df.filter(condition)


# --- widgets -----------------------------------------------------------------------------------


def _card_function(name: str, strict: bool) -> str:
    upper = str(name).strip().upper()
    if upper in CARD_AGGREGATES:
        return upper
    if strict:
        raise ValueError(f"aggregate must be one of {', '.join(CARD_AGGREGATES)}, not {name!r}")
    return "SUM"


def _aggregate(function: str, name: str | None) -> Column:
    if function == "COUNT" and name in (None, "", "*", "COUNT(*)"):
        return F.count(F.lit(1))
    return {
        "SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max,
    }[function](col(name))


def kpi(df: DataFrame, cfg: dict, strict: bool = True) -> DataFrame:
    """One value. An unknown function is refused, or read as SUM when not strict."""
    name = option(cfg, "kpiField", "xField", "field")
    function = _card_function(option(cfg, "aggregation", "yField", default="SUM"), strict)
    counted = function == "COUNT" and name in (None, "*", "COUNT(*)")
    if not counted and not name:
        raise ValueError("a KPI needs a field")
    value = _aggregate(function, name).alias("count" if counted else name)
    return _widget_filter(df, cfg).agg(value)


def chart(df: DataFrame, cfg: dict) -> DataFrame:
    """``(name, value)`` per label: by label for LINE, else by value, largest first.

    Labels break ties. COUNT counts rows whatever the value field.
    """
    label = cfg["xField"]
    function = _card_function(option(cfg, "aggregation", default="COUNT"), strict=True)
    value = (
        F.count(F.lit(1)) if function == "COUNT"
        else _aggregate(function, option(cfg, "yField", default=label))
    )
    grouped = _widget_filter(df, cfg).groupBy(col(label).alias("name")).agg(value.alias("value"))
    if str(cfg.get("type", "BAR")).upper() == "LINE":
        return grouped.orderBy(F.asc_nulls_last("name"))
    return grouped.orderBy(F.desc_nulls_first("value"), F.asc_nulls_last("name"))


def table(df: DataFrame, shared: bool = False) -> DataFrame:
    return df.limit(K.SHARED_TABLE_ROWS if shared else K.TABLE_WIDGET_ROWS)


def widget(df: DataFrame, cfg: dict) -> DataFrame:
    """The rows behind one dashboard widget."""
    kind = str(cfg.get("type", "TABLE")).upper()
    if kind == "KPI":
        return kpi(df, cfg)
    if kind in ("PIE", "BAR", "LINE", "AREA"):
        return chart(df, {**cfg, "type": kind})
    return table(df, bool(cfg.get("shared")))


def board(df: DataFrame, widgets: dict[str, dict]) -> DataFrame:
    """``(card, label, value)`` of all KPI and chart widgets, by title, from one aggregate over one scan.

    Filters become conditions inside the aggregates; the labels of charts are grouping sets, KPIs the empty one. A
    KPI has one row, with a null label, also where no row meets its filter; a chart has the rows that ``chart`` gives, unordered. Labels
    are text, values doubles, so a widget whose value is neither a number nor a count is refused.
    """
    labels = list(dict.fromkeys(c["xField"] for c in widgets.values() if _is_chart(c)))
    inputs, measures, cards = [], [], []
    for k, (title, cfg) in enumerate(widgets.items()):
        charted = _is_chart(cfg)
        if not charted and str(cfg.get("type", "KPI")).upper() != "KPI":
            raise ValueError(f"{title} is neither a KPI nor a chart")
        function = _card_function(option(cfg, "aggregation", default="COUNT" if charted else "SUM"), strict=True)
        name = option(cfg, "yField", default=cfg["xField"]) if charted else option(cfg, "kpiField", "xField", "field")
        whole = function == "COUNT" and (charted or name in (None, "*", "COUNT(*)"))
        if not whole and function != "COUNT" and not is_number(dtype_of(df, name)):
            raise ValueError(f"{title} has no number as its value")
        condition = _widget_condition(df, cfg)
        met = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        inputs += [F.when(met, F.lit(1) if whole else col(name)).alias(f"v{k}"), met.alias(f"met{k}")]
        measures += [_aggregate(function, f"v{k}").cast("double").alias(f"m{k}"), F.count_if(F.col(f"met{k}")).alias(f"n{k}")]
        cards.append((title, labels.index(cfg["xField"]) if charted else None))
    keys = [f"l{i}" for i in range(len(labels))]
    base = df.select(*[col(n).cast("string").alias(k) for n, k in zip(labels, keys)], *inputs)
    # One row that meets nothing keeps the empty grouping set alive.
    nothing = df.sparkSession.range(1).select(*[
        F.lit(False if f.name.startswith("met") else None).cast(f.dataType).alias(f.name) for f in base.schema])
    base = base.unionAll(nothing)
    every = (1 << len(keys)) - 1
    if keys:
        grouped = base.groupingSets([[]] + [[F.col(k)] for k in keys], *keys).agg(F.grouping_id().alias("g"), *measures)
    else:
        grouped = base.agg(F.lit(0).cast("long").alias("g"), *measures)
    rows = []
    for k, (title, at) in enumerate(cards):
        own = every if at is None else every & ~(1 << len(keys) - 1 - at)
        shown = (F.col("g") == own) & (F.lit(True) if at is None else F.col(f"n{k}") > 0)
        label = F.lit(None).cast("string") if at is None else F.col(keys[at])
        rows.append(F.when(shown, F.struct(F.lit(title).alias("card"), label.alias("label"), F.col(f"m{k}").alias("value"))))
    return grouped.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def _is_chart(cfg: dict) -> bool:
    return str(cfg.get("type", "")).upper() in ("PIE", "BAR", "LINE", "AREA")


def table_counts(df: DataFrame) -> DataFrame:
    """``(column, place, rows, columns, nulls)`` for each column, from one aggregate."""
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(names)])
    cells = [
        F.struct(F.lit(n).alias("column"), F.lit(i + 1).cast("long").alias("place"), F.col("rows"),
                 F.lit(len(names)).cast("long").alias("columns"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"))
        for i, n in enumerate(names)
    ]
    return row.select(F.inline(F.array(*cells)))


def distinct_values(df: DataFrame, name: str, limit: int = K.DISTINCT_VALUES) -> DataFrame:
    return (
        df.select(col(name).alias("value"))
        .filter("value is not null")
        .distinct()
        .orderBy("value")
        .limit(limit)
    )


def display_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """A column ``<name>_number`` beside each text column: numeric-looking text as a number.

    Six decimals at most; null where the text is no such number. The text itself stays.
    """
    shown = {}
    for name in names:
        looks = col(name).rlike(r"^-?\d+(\.\d+)?$") & (F.length(col(name)) <= 20)
        shown[f"{name}_number"] = F.when(looks, F.round(col(name).try_cast("double"), 6))
    return df.withColumns(shown)


# --- automatic dashboards ------------------------------------------------------------------------


def _title(name: str) -> str:
    return name.replace("_", " ")


def auto_widgets(df: DataFrame, layout: str = "overview") -> dict[str, dict]:
    """Widget configurations by title, chosen from the roles of the columns."""
    roles = {f.name: column_role(f.name, f.dataType) for f in df.schema}
    numbers = [n for n, r in roles.items() if r == "numeric"]
    labels = [n for n, r in roles.items() if r in ("categorical", "text")]
    dates = [n for n, r in roles.items() if r == "date"]
    out: dict[str, dict] = {}
    if layout == "table":
        out["Total Rows"] = {"type": "KPI", "kpiField": "*", "aggregation": "COUNT"}
        out["Columns"] = {"type": "COLUMNS"}
        out["Data Table"] = {"type": "TABLE"}
        return out
    if layout not in ("overview", "deep"):
        raise ValueError(f"unknown layout {layout!r}")

    def summed(kind: str, label: str, number: str) -> dict:
        return {"type": kind, "xField": label, "yField": number, "aggregation": "SUM"}

    for name in numbers[: 3 if layout == "overview" else 4]:
        out[f"Total {_title(name)}"] = {"type": "KPI", "kpiField": name, "aggregation": "SUM"}
    if labels and numbers:
        title = f"{_title(numbers[0])} by {_title(labels[0])}"
        out[title] = summed("BAR", labels[0], numbers[0])
    if layout == "overview":
        out["Data Preview"] = {"type": "TABLE"}
        return out
    if labels and numbers:
        second = numbers[min(1, len(numbers) - 1)]
        out[f"{_title(labels[0])} Distribution"] = summed("PIE", labels[0], second)
    if dates and numbers:
        out[f"{_title(numbers[0])} Trend"] = summed("LINE", dates[0], numbers[0])
    return out


def auto_dashboard(df: DataFrame, layout: str = "overview") -> dict[str, DataFrame]:
    """Title to rows for every widget of an automatic dashboard."""
    frames = {}
    for title, cfg in auto_widgets(df, layout).items():
        if cfg["type"] == "COLUMNS":
            frames[title] = df.sparkSession.range(1).select(
                F.lit(len(df.columns)).cast("bigint").alias("count")
            )
        else:
            frames[title] = widget(df, cfg)
    return frames


def auto_report(df: DataFrame, name: str = "table") -> dict[str, DataFrame]:
    """Fixed report set: totals, record count, bar, pie, line and a detail list, by title."""
    roles = {f.name: _report_role(f) for f in df.schema}
    numbers = [n for n, r in roles.items() if r == "numeric"]
    labels = [n for n, r in roles.items() if r == "category"]
    dates = [n for n, r in roles.items() if r == "date"]
    out = {}
    for n in numbers[:4]:
        out[f"Total {_title(n)}"] = df.agg(F.coalesce(F.sum(col(n)), F.lit(0)).alias("total"))
    out["Total Records"] = df.agg(F.count(F.lit(1)).alias("total"))

    def totals(label: str, value: Column, out_name: str) -> DataFrame:
        grouped = df.groupBy(col(label)).agg(value.alias(out_name))
        return grouped.orderBy(F.desc_nulls_first(col(out_name)), F.asc_nulls_last(col(label)))

    if numbers and labels:
        n, c = numbers[0], labels[0]
        bars = totals(c, F.sum(col(n)), n).limit(K.REPORT_BAR_GROUPS)
        out[f"{_title(n)} by {_title(c)}"] = bars
    if len(labels) > 1:
        counts = totals(labels[1], F.count(F.lit(1)), "count")
        out[f"Distribution by {_title(labels[1])}"] = counts
    elif labels and len(numbers) > 1:
        n, c = numbers[1], labels[0]
        out[f"{_title(n)} by {_title(c)}"] = totals(c, F.sum(col(n)), n)
    if dates and numbers:
        d, n = dates[0], numbers[0]
        line = df.groupBy(col(d)).agg(F.sum(col(n)).alias(n)).orderBy(F.asc_nulls_last(col(d)))
        out[f"{_title(n)} over Time"] = line
    first = F.asc_nulls_last(col(df.columns[0]))
    out[f"{name} — Detail"] = df.orderBy(first, tie_break(df)).limit(K.REPORT_DETAIL_ROWS)
    return out


def _report_role(field) -> str | None:
    """Report roles go by type; text columns whose name contains ``id`` are no categories."""
    role = column_role("", field.dataType)
    if role != "text":
        return role
    return "category" if is_text(field.dataType) and "id" not in field.name.lower() else None


# --- read-only SQL -------------------------------------------------------------------------------


def is_select_only(sql: str) -> bool:
    words = re.findall(r"[A-Z0-9_]+", sql.upper())
    return sql.strip().upper().startswith("SELECT") and not set(words) & set(K.DENIED_SQL_WORDS)


def query(spark: SparkSession, sql: str, limit: int = K.SQL_ROW_LIMIT, **tables) -> DataFrame:
    """Run a SELECT over the given frames; other statements, tables and functions are refused, results are limited.

    The frames are named inside the query alone, so views of the session stay as they are.
    """
    if not is_select_only(sql):
        raise ValueError("only SELECT statements are allowed")
    text = check_query(spark, sql.strip().removesuffix(";"), tables)
    # Names of the frames go to the parts before the query; its own braces are none of them.
    parts = ", ".join(f"`{name}` AS (SELECT * FROM {{t{i}}})" for i, name in enumerate(tables))
    text = (f"WITH {parts} " if parts else "") + text.replace("{", "{{").replace("}", "}}")
    return spark.sql(text, **{f"t{i}": frame for i, frame in enumerate(tables.values())}).limit(limit)
