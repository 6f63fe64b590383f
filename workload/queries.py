"""One query per operator. Dirty inputs are derived from the given tables by expressions."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.dates import parse_with_format
from terrace.functions.numbers import parse_number
from terrace.operators import bi, governance
from terrace.operators.aggregate import aggregate, pivot
from terrace.operators.anomaly import detect_anomalies
from terrace.operators.classify import classify
from terrace.operators.clean import clean
from terrace.operators.forecast import forecast
from terrace.operators.insight import correlations, insights, most_frequent
from terrace.operators.join import append_rows, join, latest_per_key, upsert_rows
from terrace.operators.quality import quality
from terrace.operators.transform import (
    categorize, filter_rows, page, search_rows, sort_rows, transform,
)
from terrace.operators.validate import split_valid, validate
from terrace.plans.flow import apply_steps, quarantine_table, run
from terrace.plans.templates import template
from terrace.session import scratch_folder
from terrace.sources import lake as lakes
from terrace.sources.export import archive, export_table
from terrace.sources.files import read_csv, read_records

AS_OF = datetime(2024, 1, 1)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/terrace-{uuid.uuid4().hex}"


def _lake(spark: SparkSession) -> lakes.Lake:
    return lakes.Lake(spark, _scratch(spark))


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


# --- derived dirty data ------------------------------------------------------------------------


def _amount_text(key: Column, price: Column) -> Column:
    """The price written in five ways; every tenth order has no readable price."""
    cents = F.round(price * 100).cast("bigint")
    whole = F.floor(cents / 100)
    small = F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    english = F.format_number(whole, 0)
    local = F.translate(english, ",", ".")
    kind = F.pmod(key, F.lit(10))
    return (
        F.when(kind <= 1, F.concat(F.lit("Rp "), local, F.lit(","), small))
        .when(kind == 2, F.concat(F.lit("("), local, F.lit(","), small, F.lit(")")))
        .when(kind <= 4, F.concat(F.lit("\t"), english, F.lit("."), small, F.lit(" usd")))
        .when(kind <= 6, F.concat(whole.cast("string"), F.lit("."), small, F.lit(" kg.")))
        .when(kind <= 8, local)
        .otherwise("n/a")
    )


def _date_text(key: Column, date: Column) -> Column:
    kind = F.pmod(key, F.lit(3))
    return (
        F.when(kind == 0, F.date_format(date, "dd/MM/yyyy"))
        .when(kind == 1, F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.date_format(date, "d MMM yyyy"))
    )


def _dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw text: prices, dates, padded names, and cells that are missing or blank."""
    key = F.col("o_orderkey")
    return _table(spark, sf, "orders").select(
        key,
        _amount_text(key, F.col("o_totalprice")).alias("amount"),
        _amount_text(key, F.col("o_totalprice")).alias("debit_idr"),
        _date_text(key, F.col("o_orderdate")).alias("tx_date"),
        F.when(F.pmod(key, F.lit(7)) == 0, F.lit(None))
        .when(F.pmod(key, F.lit(7)) == 1, F.lit("  "))
        .otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t "))).alias("priority"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_custkey"),
        F.lit(None).cast("string").alias("saldo"),
    )


# --- cleaning and typing -------------------------------------------------------------------------


def status_summary(spark, sf):
    steps = [
        {"type": "CLEAN", "config": {"stripWhitespace": True, "deduplicate": True}},
        {"type": "VALIDATE", "config": {
            "validationRules":
                "NOT_NULL:o_orderpriority\nNUMBER:o_totalprice,min=0\n"
                "ENUM:o_orderstatus,values=F,O,P",
        }},
        {"type": "AGGREGATE", "config": {
            "groupBy": "o_orderstatus",
            "aggregations": "total = SUM(o_totalprice)\ncount = COUNT(*)\navg = AVG(o_totalprice)",
        }},
        {"type": "SORT", "config": {"by": "o_orderstatus"}},
    ]
    steps = [{**s, "order": i} for i, s in enumerate(steps)]
    out = apply_steps(_table(spark, sf, "orders"), steps)
    return out.withColumns({"total": F.round("total", 2), "avg": F.round("avg", 4)})


def clean_currency(spark, sf):
    return _dirty_orders(spark, sf).select(
        "o_orderkey", parse_number(F.col("amount")).alias("amount")
    )


def strip_dedup(spark, sf):
    priorities = _dirty_orders(spark, sf).select("priority", "status")
    return clean(
        priorities, {"stripWhitespace": True, "deduplicate": True, "autoTypeInference": False}
    )


def infer_types(spark, sf):
    return clean(
        _dirty_orders(spark, sf).select(
            "o_orderkey", "amount", "debit_idr", "tx_date", "priority", "saldo"
        ),
        {"stripWhitespace": True},
    ).withColumn("priority", F.nullif("priority", F.lit("")))


def date_formats(spark, sf):
    orders = _table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return orders.select("o_orderkey", parse_with_format(text, "DD/MM/YYYY").alias("parsed"))


def fill_nulls_constant(spark, sf):
    return clean(
        _dirty_orders(spark, sf).select("o_orderkey", "priority", "status"),
        {"autoTypeInference": False, "fillNulls": True, "fillNullsValue": "none given"},
    )


def fill_nulls_template(spark, sf):
    return clean(
        _dirty_orders(spark, sf).select("o_orderkey", "o_custkey", "priority", "status"),
        {
            "autoTypeInference": False,
            "fillNulls": '{"status": "REVIEW_{o_orderkey}_{status}_{nope}", "priority": "-"}',
        },
    )


def harden_types(spark, sf):
    dirty = _dirty_orders(spark, sf)
    return lakes.harden_types(dirty.select(
        "o_orderkey", F.col("amount").alias("total_amount"), "tx_date", "status"
    ))


# --- validation -----------------------------------------------------------------------------------

RULES = (
    "NOT_NULL:Priority\nNUMBER:amount,min=1000,max=400000\nDATE:tx date\n"
    "ENUM:status,values=f,o\nREGEX:tx_date,pattern=\\d{4}-0"
)


def validate_flag(spark, sf):
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "amount", "tx_date", "priority", "status")
    return validate(dirty, {"validationRules": RULES}).select(
        "o_orderkey", "amount", "tx_date", K.ISSUES
    )


def validate_drop(spark, sf):
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "amount", "priority", "status")
    rules = "NOT_NULL:priority\nNUMBER:amount,min=1000,max=400000\nENUM:status,values=F,O"
    return validate(dirty, {"rules": rules, "validationMode": "drop"})


def validate_rejects(spark, sf):
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "amount", "status")
    rules = [{"type": "number", "column": "amount", "max": 400000}, {"type": "not_null", "column": "status"}]
    return split_valid(dirty, {"rules": rules})[1]


def validate_compare(spark, sf):
    lines = _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).cast("string").alias("net"),
        "l_extendedprice",
    )
    out = validate(lines, {"rules": "COMPARE:net,l_extendedprice,2500\nCOMPARE:l_discount,l_tax,0.03"})
    return out.groupBy(K.ISSUES).agg(F.count(F.lit(1)).alias("rows"))


def validate_unique(spark, sf):
    lines = _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"
    )
    return validate(lines, {"validationRules": "UNIQUE:l_orderkey"})


def outlier_iqr(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "value")
    return validate(events, {"validationRules": "OUTLIER:value,method=iqr"})


def outlier_zscore(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "value")
    return validate(events, {"validationRules": "OUTLIER:value,method=zscore,threshold=2.5"})


# --- projections, filters, sorting -----------------------------------------------------------------


def categorize_tiers(spark, sf):
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return categorize(orders, {
        "field": "o_totalprice",
        "newColumn": "tier",
        "categories": [
            {"label": "low", "max": 100000},
            {"label": "mid", "min": 100000, "max": 300000},
            {"min": 250000, "max": 280000},
            {"label": "high", "min": 320000},
        ],
    }).drop("o_totalprice")


def categorize_conditions(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "value", "event_type")
    return categorize(events, {
        "categorizeField": "value",
        "categories": "Low: value < 20\nMedium: value >= 20 AND value < 100\nError: event_type = 'error'",
    }).select("event_id", "value_tier")


def calc_filter(spark, sf):
    out = transform(_table(spark, sf, "lineitem"), {
        "calculatedColumns":
            "net = l_extendedprice * (1 - l_discount)\nflags = l_returnflag || '-' || l_linestatus\n"
            "broken = no_such_column + 1",
        "rename": {"l_quantity": "quantity"},
        "drop": ["l_tax", "not_there"],
    })
    kept = filter_rows(out, {"condition": "quantity > 45 and l_returnflag in ['A', 'R'] & net != 0"})
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "quantity", "flags", F.round("net", 4).alias("net")
    )


def cast_columns(spark, sf):
    orders = _table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.regexp_extract("o_orderpriority", r"^(\d)", 1).alias("rank"),
    )
    return transform(orders, {
        "cast": {"rank": "integer", "o_custkey": "string", "o_orderpriority": "number"}
    })


def filters_all_ops(spark, sf):
    part = _table(spark, sf, "part")
    orders = _table(spark, sf, "orders")
    events = _table(spark, sf, "events")
    cases = {
        "equals": (part, {"field": "p_brand", "operator": "EQUALS", "value": "Brand#2"}),
        "not_equals": (part, {"field": "p_size", "operator": "NOT_EQUALS", "value": 11}),
        "greater": (part, {"field": "p_retailprice", "operator": "GREATER_THAN", "value": "1000"}),
        "less": (part, {"field": "p_size", "operator": "LESS_THAN", "value": 20}),
        "between": (orders, {"field": "o_totalprice", "operator": "BETWEEN", "value": [1000, 90000]}),
        "in": (orders, {"field": "o_orderstatus", "operator": "IN", "value": ["F", "P"]}),
        "contains": (part, {"field": "p_name", "operator": "CONTAINS", "value": "RED"}),
        "ignored": (events, {"field": "value", "operator": "EQUALS", "value": ""}),
    }
    return _union(
        bi.apply_filters(df, [f]).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("operator"), "rows")
        for name, (df, f) in cases.items()
    )


def filters_combined(spark, sf):
    return bi.apply_filters(_table(spark, sf, "orders"), [
        {"field": "o_orderdate", "operator": "BETWEEN", "value": ["1996-01-01", "1998-12-31"]},
        {"field": "o_orderstatus", "operator": "NOT_EQUALS", "value": "P"},
        {"field": "o_orderpriority", "operator": "CONTAINS", "value": "high"},
    ]).select("o_orderkey", "o_totalprice")


def table_search_page(spark, sf):
    found = search_rows(_table(spark, sf, "part"), "bolt")
    return page(found, [F.col("p_retailprice").desc(), F.col("p_partkey")], number=2)


def sort_rows_nulls_last(spark, sf):
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "status", "o_custkey")
    ordered = sort_rows(dirty, {"by": ["status", "o_custkey"], "ascending": [False, True]})
    return filter_rows(ordered, {"condition": "o_orderkey >= 0"})


def sort_first_rows(spark, sf):
    """The first rows of both directions: an order that is not kept gives other rows."""
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "status", "o_custkey")
    first = [
        filter_rows(sort_rows(dirty, {"by": ["status", "o_custkey", "o_orderkey"], "ascending": ups}), {"condition": "LIMIT 500"})
        .withColumn("direction", F.lit(name))
        for name, ups in (("down", [False, False, False]), ("up", [True, True, True]))
    ]
    return first[0].unionByName(first[1])


def export_csv_back(spark, sf):
    """A whole table exported as quoted CSV and read again."""
    path = _scratch(spark)
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "priority", "status")
    export_table(dirty, path, "csv", limit=None)
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.coalesce("priority", F.lit("")).alias("priority"),
                       F.coalesce("status", F.lit("")).alias("status"))


def archive_back(spark, sf):
    """A table archived as Parquet and read again."""
    path = _scratch(spark)
    archive(_dirty_orders(spark, sf).select("o_orderkey", "status"), path)
    return spark.read.parquet(path)


def topn_customers(spark, sf):
    steps = [
        {"type": "AGGREGATE", "order": 1, "config": {
            "groupBy": "o_custkey", "aggregations": {"total": "o_totalprice SUM", "orders": "* COUNT"},
        }},
        {"type": "SORT", "order": 2, "config": {"sortField": "total", "sortDirection": "DESC"}},
        {"type": "FILTER", "order": 3, "config": {"filterCondition": "LIMIT 10"}},
    ]
    out = apply_steps(_table(spark, sf, "orders"), steps)
    return out.withColumn("total", F.round("total", 2))


def union_missing_columns(spark, sf):
    customers = _table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    suppliers = _table(spark, sf, "supplier").select(
        F.col("s_name").alias("NAME"), F.col("s_acctbal").alias("balance"), "s_nationkey"
    )
    return append_rows(customers, suppliers)


# --- joins -----------------------------------------------------------------------------------------


def _keyed_orders(spark, sf):
    key = F.col("o_orderkey")
    return _table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.pmod(key, F.lit(9)) != 0, F.col("o_custkey")).alias("k"),
        F.col("o_totalprice").alias("amount"),
    )


def _keyed_customers(spark, sf):
    key = F.col("c_custkey")
    return _table(spark, sf, "customer").select(
        F.when(key != 5, key).alias("k"), "c_name", F.col("c_acctbal").alias("amount")
    )


def _joined(how):
    def query(spark, sf):
        return join(_keyed_orders(spark, sf), _keyed_customers(spark, sf), {"type": how, "on": "k"})

    return query


def join_composite(spark, sf):
    sold = _table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    sold = sold.withColumnsRenamed({"l_partkey": "part", "l_suppkey": "supplier"})
    pairs = sold.groupBy("part", "supplier").agg(F.max("l_quantity").alias("most"))
    out = join(sold, pairs, {"joinType": "LEFT", "joinKey": "part, supplier"})
    return out.groupBy("part", "supplier").agg(
        F.count(F.lit(1)).alias("lines"), F.max("most").alias("most")
    )


# --- aggregates ------------------------------------------------------------------------------------


def _rollup(unit):
    def query(spark, sf):
        out = aggregate(_table(spark, sf, "orders"), {
            "groupBy": unit,
            "aggregations": "total = SUM(o_totalprice)\ncount = COUNT(*)\navg = AVG(o_totalprice)",
        })
        return out.withColumns({"total": F.round("total", 2), "avg": F.round("avg", 8)})

    return query


def pivot_status_priority(spark, sf):
    out = pivot(_table(spark, sf, "orders"), {
        "pivotRows": "o_orderstatus", "pivotColumns": "o_orderpriority", "pivotValues": "o_totalprice",
    })
    values = [n for n in out.columns if n != "o_orderstatus"]
    return out.select(
        "o_orderstatus", *[F.round(F.col(f"`{n}`"), 2).alias("p" + n[0]) for n in values]
    )


def pivot_fixed_columns(spark, sf):
    return pivot(_table(spark, sf, "lineitem"), {
        "pivotRows": "l_returnflag", "pivotColumns": "l_linestatus", "pivotValues": "l_orderkey",
        "aggregation": "COUNT", "pivotColumnValues": ["F", "O"],
    })


def agg_null_semantics(spark, sf):
    key = F.col("o_orderkey")
    orders = _table(spark, sf, "orders").select(
        F.when(F.pmod(key, F.lit(11)) != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
    )
    out = aggregate(orders, {"groupBy": "priority", "aggregations": (
        "total = SUM(price)\nrows = COUNT(*)\npriced = COUNT(price)\nlow = MIN(price)\n"
        "high = MAX(price)\nskipped = MEDIAN(price)\nmean = AVERAGE(price)"
    )})
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def agg_global(spark, sf):
    out = aggregate(
        _table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "amount"),
        template("gold-kpi")[2]["config"],
    )
    return out.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


def table_counts(spark, sf):
    dirty = _dirty_orders(spark, sf)
    return dirty.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(dirty.columns)).cast("bigint").alias("columns"),
        F.count_if(F.col("priority").isNull()).alias("null_priority"),
        F.count_if(F.col("status").isNull()).alias("null_status"),
    )


# --- dashboards --------------------------------------------------------------------------------------


def kpi_cards(spark, sf):
    orders = _table(spark, sf, "orders")
    cards = {
        "sum": {"kpiField": "o_totalprice"},
        "avg": {"xField": "o_totalprice", "yField": "avg"},
        "count": {"aggregation": "COUNT"},
        "filtered": {"kpiField": "o_totalprice", "aggregation": "MAX",
                     "filterField": "o_orderstatus", "filterValue": "F"},
        "numeric_filter": {"kpiField": "o_orderkey", "aggregation": "COUNT",
                           "filterField": "o_custkey", "filterValue": "370"},
        "unknown": {"kpiField": "o_totalprice", "aggregation": "median"},
    }
    return _union(
        (card := bi.kpi(orders, cfg, strict=name != "unknown")).select(
            F.lit(name).alias("card"),
            F.round(F.col(card.columns[0]).cast("double"), 2).alias("value"),
        )
        for name, cfg in cards.items()
    )


def board_one_scan(spark, sf):
    """KPIs and charts with and without filters from one aggregate."""
    out = bi.board(_table(spark, sf, "orders"), {
        "total": {"kpiField": "o_totalprice"},
        "average": {"kpiField": "o_totalprice", "aggregation": "AVG", "filterField": "o_orderstatus", "filterValue": "F"},
        "orders": {"aggregation": "COUNT"},
        "one customer": {"kpiField": "o_orderkey", "aggregation": "COUNT", "filterField": "o_custkey", "filterValue": "370"},
        "nobody": {"kpiField": "o_totalprice", "filterField": "o_custkey", "filterValue": "-1"},
        "by priority": {"type": "BAR", "xField": "o_orderpriority"},
        "by status": {"type": "PIE", "xField": "o_orderstatus", "yField": "o_totalprice", "aggregation": "SUM"},
        "urgent by day": {"type": "LINE", "xField": "o_orderdate", "yField": "o_totalprice", "aggregation": "MAX",
                          "filterField": "o_orderpriority", "filterValue": "1-URGENT"},
    })
    return out.withColumn("value", F.round("value", 2))


def table_counts_all(spark, sf):
    return bi.table_counts(_dirty_orders(spark, sf))


def chart_bar(spark, sf):
    return bi.widget(_table(spark, sf, "orders"), {"type": "BAR", "xField": "o_orderpriority"})


def chart_pie(spark, sf):
    out = bi.widget(_table(spark, sf, "part"), {
        "type": "PIE", "xField": "p_brand", "yField": "p_retailprice", "aggregation": "SUM",
        "filterField": "p_type", "filterValue": "ECONOMY",
    })
    return out.withColumn("value", F.round("value", 2))


def chart_line(spark, sf):
    out = bi.widget(_table(spark, sf, "orders"), {
        "type": "LINE", "xField": "o_orderdate", "yField": "o_totalprice", "aggregation": "AVG",
    })
    return out.withColumn("value", F.round("value", 8))


def distinct_values(spark, sf):
    return bi.distinct_values(_dirty_orders(spark, sf), "o_custkey")


def table_widget(spark, sf):
    return bi.widget(_table(spark, sf, "lineitem"), {"type": "TABLE"})


def _long(frames: dict[str, DataFrame]) -> DataFrame:
    rows = []
    for title, df in frames.items():
        label = F.lit(None) if len(df.columns) == 1 else F.col(df.columns[0])
        value = F.col(df.columns[-1]).cast("double")
        rows.append(df.select(
            F.lit(title).alias("card"), label.cast("string").alias("label"),
            F.round(value, 2).alias("value"),
        ))
    return _union(rows)


def auto_dashboard(spark, sf):
    parts = _table(spark, sf, "part").select("p_brand", "p_retailprice", "p_partkey")
    return _long({
        **{t: d for t, d in bi.auto_dashboard(parts, "deep").items()},
        **{t: d for t, d in bi.auto_dashboard(parts, "table").items() if t != "Data Table"},
    })


def auto_report(spark, sf):
    orders = _table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    report = bi.auto_report(orders, "orders")
    return _long({t: d for t, d in report.items() if "Detail" not in t})


def report_detail(spark, sf):
    return bi.auto_report(_table(spark, sf, "orders"), "orders")["orders — Detail"]


def read_only_sql(spark, sf):
    return bi.query(
        spark,
        "SELECT p_type, count(*) AS parts, round(avg(p_size), 4) AS size FROM part_sizes "
        "GROUP BY p_type ORDER BY p_type;",
        part_sizes=_table(spark, sf, "part"),
    )


def display_numbers(spark, sf):
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "amount", (F.col("o_custkey") / 7).cast("string").alias("ratio"))
    return bi.display_numbers(dirty, ["amount", "ratio"]).drop("amount", "ratio")


# --- analytics ---------------------------------------------------------------------------------------


def quality_score(spark, sf):
    return quality(_table(spark, sf, "lineitem"))


def quality_score_dirty(spark, sf):
    events = _table(spark, sf, "events").select("event_type", "value", "user_id")
    return quality(events.withColumn(
        "value", F.when(F.col("event_type") != "error", F.round(F.col("value"), 0))
    ))


def insight_facts(spark, sf):
    part = _table(spark, sf, "part").withColumn("p_cost", F.col("p_retailprice") * 2 - F.col("p_size"))
    return insights(part).select("kind", "column", "column2", F.round("value", 4).alias("value"))


def insight_outliers(spark, sf):
    events = _table(spark, sf, "events").select("value", "event_type")
    return insights(events).select("kind", "column", "column2", F.round("value", 4).alias("value"))


def correlation_pairs(spark, sf):
    return correlations(_table(spark, sf, "lineitem")).withColumn("r", F.round("r", 6))


def most_frequent_value(spark, sf):
    return most_frequent(_table(spark, sf, "lineitem"), "l_shipdate")


def anomaly_zscore(spark, sf):
    events = _table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("value")).alias("value"), "user_id"
    )
    return detect_anomalies(events, {"method": "zscore", "columns": ["value", "user_id"]}).drop("user_id")


def anomaly_forest(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "value", "user_id")
    return detect_anomalies(events, {"columns": ["value", "user_id"]})


def forecast_linear(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "ts", "value")
    return forecast(events, {"dateColumn": "ts", "targetColumn": "value", "horizon": 14})


def forecast_tied_dates(spark, sf):
    orders = _table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    out = forecast(orders, {"horizon": 30})
    return out.filter("o_totalprice_forecast is not null").drop("o_totalprice")


def classify_text(spark, sf):
    documents = _table(spark, sf, "documents").select("doc_id", "text")
    return classify(documents, {"textColumn": "text"}).select("doc_id", "sentiment_label")


def classify_turns(spark, sf):
    turns = _table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("text")
    )
    return classify(turns, {"textColumn": "text", "mode": "topic"}).drop("text")


# --- governance --------------------------------------------------------------------------------------


def mask_pii(spark, sf):
    key = F.col("c_custkey")
    kind = F.pmod(key, F.lit(5))
    number = F.lpad(key.cast("string"), 10, "0")
    people = _table(spark, sf, "customer").select(
        "c_custkey",
        F.when(kind == 0, F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.id")))
        .when(kind == 1, "ab@mail.id").when(kind == 2, "z@mail.id").when(kind == 3, "no mail")
        .alias("email_address"),
        F.when(kind == 0, F.concat(F.lit(" 08"), number)).when(kind == 1, "123456")
        .when(kind == 2, "1234567").when(kind == 3, "0812345").alias("phone"),
        F.when(kind == 0, F.concat(F.lit("320101"), number)).when(kind == 1, "123456789")
        .when(kind == 2, " 1234567890 ").alias("nik"),
        F.when(kind == 0, F.concat(F.lit("4111-1111 "), number)).when(kind == 1, "1234 567-8901")
        .when(kind == 2, "123456789012").alias("card_no"),
    )
    return governance.mask_dataset(people)


def platform_metrics(spark, sf):
    sources = _table(spark, sf, "supplier").select((F.col("s_nationkey") + 1).alias("tenantId"))
    pipelines = _table(spark, sf, "part").select(
        (F.pmod(F.col("p_size"), F.lit(3)) + 1).alias("tenantId"),
        F.when(F.col("p_size") > 25, "ACTIVE").otherwise("DRAFT").alias("status"),
    )
    runs = _run_log(spark, sf)
    audits = _table(spark, sf, "conversations").select(F.lit(1).alias("tenantId"))
    every = governance.metrics(sources, pipelines, runs, audits)
    one = governance.metrics(sources, pipelines, runs, audits, tenant=1)
    return every.withColumn("scope", F.lit("all")).unionAll(one.withColumn("scope", F.lit("tenant")))


def _run_log(spark, sf):
    kind = F.col("event_type")
    return _table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("pipelineId"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "RUNNING").otherwise("SUCCESS").alias("status"),
        F.col("value").alias("duration"),
        F.when(kind != "signup", F.col("user_id") * 10).alias("rowsOutput"),
        F.col("ts").alias("createdAt"),
    )


def latest_run_per_pipeline(spark, sf):
    runs = _run_log(spark, sf).select("pipelineId", "createdAt", "id", "status")
    return latest_per_key(runs, ["pipelineId"], ["createdAt", "id"])


def audit_page(spark, sf):
    log = _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("createdAt"),
        F.col("event_type").alias("action"), F.lit("table").alias("resource"),
        F.lit(1).alias("tenantId"), "user_id",
    )
    rows, _ = governance.audit_events(log, tenant=1, action="purchase", limit=50, offset=25)
    return rows.select("id", "createdAt", "user_id")


def audit_total(spark, sf):
    log = _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("createdAt"), F.col("event_type").alias("action")
    )
    return governance.audit_events(log, action="click")[1]


def layer_overview(spark, sf):
    catalog = _table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "BRONZE").when(F.col("o_orderstatus") == "O", "SILVER")
        .otherwise("OTHER").alias("layer")
    )
    return governance.layer_counts(catalog)


def recent_items(spark, sf):
    return governance.most_recent(_table(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", 5)


# --- tables and files --------------------------------------------------------------------------------


def table_discovery(spark, sf):
    found = lakes.describe_tables(spark, {t: _table(spark, sf, t) for t in TABLES})
    return found.select("table_name", "column_count", "row_count")


def source_profile(spark, sf):
    return lakes.source_profile(_table(spark, sf, "documents"))


def table_preview(spark, sf):
    return lakes.preview(_table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])[0]


def table_total(spark, sf):
    return lakes.preview(_table(spark, sf, "orders"))[1]


def table_schema(spark, sf):
    """Schema listing of a written table, with its row count to tie it to the data."""
    lake = _lake(spark)
    rows = lake.overwrite(_table(spark, sf, "events"), "silver", "events")
    listed = lakes.table_schema(lake.read("silver", "events"))
    return listed.withColumn("rows", F.lit(rows).cast("bigint"))


def csv_scan(spark, sf):
    """Customers written as a raw file by Spark, read back without inference."""
    path = _scratch(spark)
    _table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return read_csv(spark, path)


def csv_latin1_late(spark, sf):
    """A Latin-1 file whose accents come after the lines that a sample would show."""
    path = _scratch(spark)
    name = F.when(F.col("c_custkey") > 1000, F.concat("c_name", F.lit(" José"))).otherwise(F.col("c_name"))
    customers = _table(spark, sf, "customer").select("c_custkey", name.alias("c_name"))
    customers.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path)


def _raw_lines(spark, sf, path, wanted):
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    line = (
        F.when(F.col("o_orderpriority") == "5-LOW", key)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat_ws(",", key, status, F.lit("x")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws(",", key, status, F.lit("")))
        .otherwise(F.concat(key, F.lit(',"'), status, F.lit(',"')))
    )
    lines = _table(spark, sf, "orders").filter(wanted).select(line.alias("key,status"))
    # One unquoted column, so each file holds the lines as they are under a header line.
    lines.write.mode("append").option("header", True).option("sep", "\x01").option("quote", "").csv(path)


def csv_bad_rows(spark, sf):
    """Raw files in which some lines have too few or too many fields."""
    path = _scratch(spark)
    _raw_lines(spark, sf, path, F.lit(True))
    return read_csv(spark, path)


def records_scan(spark, sf):
    """Events written as JSON lines by Spark, read back as text columns."""
    path = _scratch(spark)
    record = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "map<string,int>").alias("props")))
    _table(spark, sf, "events").select(record.alias("value")).write.text(path)
    return read_records(spark, path, lines=True)


def records_array(spark, sf):
    """JSON files that hold one array each, of a thousand events at most."""
    path = _scratch(spark)
    record = F.struct("event_id", "event_type", F.from_json("props", "map<string,int>").alias("props"))
    arrays = _table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return read_records(spark, path)


def append_widen(spark, sf):
    """A table of ints that takes bigints, then texts that hold numbers."""
    lake = _lake(spark)
    orders = _table(spark, sf, "orders").select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int").alias("n"))
    lake.overwrite(orders, "silver", "t")
    lake.append(orders.select("o_orderkey", (F.col("n") * F.lit(3_000_000_000)).alias("n")), "silver", "t")
    lake.append(orders.select("o_orderkey", F.concat(F.lit("-"), "n").alias("n")), "silver", "t")
    return lake.read("silver", "t")


def bronze_ingest(spark, sf):
    lake = _lake(spark)
    path = _scratch(spark)
    _table(spark, sf, "supplier").write.option("header", True).csv(path)
    table, _, _ = lake.ingest(read_csv(spark, path), 12, AS_OF)
    return lake.read("bronze", table)


def extract_landing(spark, sf):
    lake = _lake(spark)
    table, _ = lake.ingest_extract(_table(spark, sf, "nation"), 4)
    return lake.read("bronze", table)


def lineage_stamp(spark, sf):
    nations = _table(spark, sf, "nation")
    return lakes.stamp(nations, {"run_id": 7, "pipeline_id": 3}, AS_OF)


def _split_orders(spark, sf):
    """Open and finished orders as the table; open and pending ones, changed, as the batch."""
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    target = orders.filter(F.col("o_orderstatus") != "P")
    batch = orders.filter(F.col("o_orderstatus") != "F").select(
        "o_orderkey",
        F.col("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.col("o_totalprice") + 1, 2)).alias("O_TotalPrice"),
        F.lit("late").alias("note"),
    )
    return target, batch


def upsert_merge(spark, sf):
    target, batch = _split_orders(spark, sf)
    return upsert_rows(target, batch, ["o_orderkey"])


def upsert_table(spark, sf):
    lake = _lake(spark)
    target, batch = _split_orders(spark, sf)
    lake.overwrite(target, "silver", "orders")
    lake.upsert(batch, "silver", "orders", ["o_orderkey"])
    return lake.read("silver", "orders")


def append_evolve(spark, sf):
    lake = _lake(spark)
    target, batch = _split_orders(spark, sf)
    lake.overwrite(target, "silver", "orders")
    lake.append(batch, "silver", "orders")
    return lake.read("silver", "orders")


def medallion_flow(spark, sf):
    """Bronze, silver and gold in one flow; the result is the gold table."""
    lake = _lake(spark)
    steps = template("medallion", {
        "CLEAN": {"stripWhitespace": True},
        "AGGREGATE": {"groupBy": "status, priority",
                      "aggregations": "total = SUM(amount)\nrows = COUNT(*)\nfirst = MIN(tx_date)"},
    }, "orders")
    dirty = _dirty_orders(spark, sf).select("o_orderkey", "amount", "tx_date", "priority", "status")
    run(lake, {"steps": steps, "runId": 5, "pipelineId": 2}, dirty, AS_OF)
    out = lake.read("gold", "gold_orders")
    return out.withColumn("total", F.round("total", 2)).drop(K.ETL_TIMESTAMP)


def quarantine_flow(spark, sf):
    """Rows taken out by a flow, as kept in its quarantine table."""
    lake = _lake(spark)
    steps = [
        {"type": "VALIDATE", "order": 1, "config": {
            "validationRules": "NOT_NULL:status\nENUM:status,values=F", "validationMode": "drop"}},
        {"type": "OUTPUT", "order": 2, "outputLayer": "SILVER", "outputTable": "good"},
    ]
    run(lake, {"steps": steps}, _dirty_orders(spark, sf).select("o_orderkey", "status"), AS_OF)
    return lake.read("silver", quarantine_table(0, 1))


def failed_rows_record(spark, sf):
    lake = _lake(spark)
    steps = [{"type": "VALIDATE", "order": 1, "config": {
        "validationRules": "NOT_NULL:status", "validationMode": "drop"}}]
    run(lake, {"steps": steps}, _dirty_orders(spark, sf).select("o_orderkey", "status"), AS_OF)
    return lake.read("silver", K.FAILED_ROWS_TABLE).select("reason")


def output_metadata(spark, sf):
    lake = _lake(spark)
    steps = [{"type": "OUTPUT", "order": 1, "outputLayer": "BRONZE", "outputTable": "raw_events"}]
    run(lake, {"steps": steps}, _table(spark, sf, "events"), AS_OF)
    return lake.catalog().select("layer", "tableName", "displayName", "rowsCount", "updatedAt")


def incremental_ingest(spark, sf):
    """Customers landed as files and taken up by a stream."""
    from terrace.streaming.ingest import append_stream, landed_files

    landing, lake, mark = _scratch(spark), _lake(spark), _scratch(spark)
    customers = _table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers.write.option("header", True).csv(landing)
    for _ in range(2):  # the second run finds nothing new
        stream = landed_files(spark, landing, customers.columns, 3)
        append_stream(stream, lake, "bronze", "customers", mark).awaitTermination()
    return lake.read("bronze", "customers").drop(K.INGESTED_AT)


def stream_bad_rows(spark, sf):
    """The raw lines of ``csv_bad_rows`` as a stream, in two landings."""
    from terrace.streaming.ingest import append_stream, landed_files

    landing, lake, mark = _scratch(spark), _lake(spark), _scratch(spark)
    for part in (0, 1):
        _raw_lines(spark, sf, landing, F.col("o_orderkey") % 2 == part)
        append_stream(landed_files(spark, landing, ["key", "status"], 4), lake, "bronze", "lines", mark).awaitTermination()
    return lake.read("bronze", "lines").drop(K.INGESTED_AT)


def incremental_upsert(spark, sf):
    """A stream of events that keeps the newest event of each user."""
    from terrace.streaming.ingest import upsert_stream

    landing, mark, lake = _scratch(spark), _scratch(spark), _lake(spark)
    events = _table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    events.write.parquet(landing)
    stream = spark.readStream.schema(events.schema).parquet(landing)
    upsert_stream(stream, lake, "silver", "users", ["user_id"], mark, ["ts", "event_id"]).awaitTermination()
    return lake.read("silver", "users")


QUERIES = {
    f.__name__: f
    for f in (
        append_widen, csv_latin1_late, records_array, stream_bad_rows,
        status_summary, clean_currency, strip_dedup, infer_types, date_formats, fill_nulls_constant,
        fill_nulls_template, harden_types, validate_flag, validate_drop, validate_rejects,
        validate_compare, validate_unique, outlier_iqr, outlier_zscore, categorize_tiers,
        categorize_conditions, calc_filter, cast_columns, filters_all_ops, filters_combined,
        table_search_page, sort_rows_nulls_last, sort_first_rows, export_csv_back, archive_back, topn_customers, union_missing_columns,
        join_composite, pivot_status_priority, pivot_fixed_columns, agg_null_semantics, agg_global,
        table_counts, table_counts_all, kpi_cards, board_one_scan, chart_bar, chart_pie, chart_line, distinct_values, table_widget,
        auto_dashboard, auto_report, report_detail, read_only_sql, display_numbers, quality_score,
        quality_score_dirty, insight_facts, insight_outliers, correlation_pairs,
        most_frequent_value, anomaly_zscore, anomaly_forest, forecast_linear, forecast_tied_dates,
        classify_text, classify_turns, mask_pii, platform_metrics, latest_run_per_pipeline,
        audit_page, audit_total, layer_overview, recent_items, table_discovery, source_profile,
        table_preview, table_total, table_schema, csv_scan, csv_bad_rows, records_scan,
        bronze_ingest, extract_landing, lineage_stamp, upsert_merge, upsert_table, append_evolve,
        medallion_flow, quarantine_flow, failed_rows_record, output_metadata, incremental_ingest,
        incremental_upsert,
    )
}
QUERIES |= {f"join_{h}": _joined(h) for h in ("left", "inner", "right", "full")}
QUERIES |= {f"rollup_{u}": _rollup(u) for u in ("daily", "weekly", "monthly")}
