import json
import math
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.operators import anomaly, bi, governance
from terrace.operators import quantiles as Q
from terrace.operators.aggregate import aggregate, parse_aggregations, pivot
from terrace.operators.anomaly import detect_anomalies
from terrace.operators.classify import classify
from terrace.operators.clean import clean, fill_nulls, infer_types
from terrace.operators.forecast import fit_trend, forecast
from terrace.operators.insight import correlations, insights, narratives
from terrace.operators.join import join, latest_per_key, upsert_rows
from terrace.operators.quality import quality
from terrace.operators.transform import categorize, filter_rows, page, search_rows, sort_rows, transform
from terrace.operators.validate import parse_rules, split_valid, validate


def issues(df, rules, **config):
    out = validate(df, {"validationRules": rules, **config})
    return [r[K.ISSUES] for r in out.orderBy(df.columns[0]).collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- validation ------------------------------------------------------------------------------------


def test_not_null(spark):
    df = spark.createDataFrame([(1, "Alice"), (2, ""), (3, None)], "id int, name string")
    assert issues(df, "NOT_NULL:name") == ["PASS", "Missing name", "Missing name"]


def test_compare(spark):
    df = spark.createDataFrame([(1000, 1000), (2000, 2000), (3000, 3500)], "sap_amt int, bank_amt int")
    assert issues(df, "COMPARE:sap_amt,bank_amt,0") == ["PASS", "PASS", "Mismatch sap_amt vs bank_amt"]
    text = spark.createDataFrame([(1, "Rp 5", None)], "id int, a string, b string")
    assert issues(text, "COMPARE:a,b,4.5") == ["Mismatch a vs b"]


def test_enum(spark):
    data = list(enumerate(["ACTIVE", "inactive", "PENDING", "INVALID", None]))
    df = spark.createDataFrame(data, "id int, status string")
    bad = "Invalid enum status"
    assert issues(df, "ENUM:status,values=ACTIVE,INACTIVE,PENDING") == ["PASS"] * 3 + [bad, bad]


def test_unique(spark):
    df = spark.createDataFrame([(1, "A1"), (2, "B2"), (3, "A1"), (4, None), (5, None)], "id int, code string")
    dup = "Duplicate code"
    assert issues(df, "UNIQUE:code") == [dup, "PASS", dup, dup, dup]


def test_number_date_regex(spark):
    df = spark.createDataFrame(
        [(1, "5", "2024-01-05", "AB-1", None), (2, "x", "31/02/2024", "ab-1", "y"), (3, " ", None, None, "1")],
        "id int, amount string, day string, code string, credit string",
    )
    rules = "NUMBER:amount,min=6\nDATE:day\nREGEX:code,pattern=[A-Z]{2}-\\d\nNUMBER:credit\nREGEX:code,pattern=(["
    out = validate(df, {"rules": rules}).orderBy("id").collect()
    assert [r[K.ISSUES] for r in out] == [
        "amount < 6.0; Regex mismatch code",
        "Invalid number in amount; Invalid date format in day; Regex mismatch code; Regex mismatch code",
        "Regex mismatch code; Regex mismatch code",
    ]
    assert [r.amount for r in out] == [5.0, None, None]
    assert [r.credit for r in out] == [0.0, 0.0, 1.0]
    assert out[0].day == datetime(2024, 1, 5)
    us = validate(df.limit(1).withColumn("day", F.lit("01/02/2024")), {"rules": "DATE:day,locale=US"})
    assert us.first().day == datetime(2024, 1, 2)


def test_outliers_need_fifteen_rows(spark):
    few = spark.createDataFrame([(i, float(i)) for i in range(13)] + [(99, 1e6)], "id int, v double")
    assert set(issues(few, "OUTLIER:v")) == {"PASS"}
    many = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, 1e6)], "id int, v double")
    assert issues(many, "OUTLIER:v,method=iqr")[-1] == "Outlier v"
    assert issues(many, "OUTLIER:v,method=zscore,threshold=2")[-1] == "Outlier v"


def test_drop_mode_and_finance(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    config = {"rules": "NOT_NULL:v", "validationMode": "drop"}
    kept, rejected = split_valid(df, config)
    assert rows(kept) == [(1, "a")] and rows(rejected) == [(2, None)]
    assert validate(df, config).columns == ["id", "v"]
    flagged = validate(df, {**config, "_source_category": "Keuangan / Finance"})
    assert flagged.count() == 2 and K.ISSUES in flagged.columns


def test_rule_text():
    assert parse_rules("NUMBER:a,min=1,max=2\nbad line\nUNIQUE:a,b\nDATE:d,YYYY-MM-DD") == [
        {"type": "NUMBER", "column": "a", "min": 1.0, "max": 2.0},
        {"type": "UNIQUE", "column": "a,b"},
        {"type": "DATE", "column": "d", "format": "YYYY-MM-DD", "locale": None},
    ]


# --- cleaning -----------------------------------------------------------------------------------------


def test_infer_types(spark):
    df = spark.createDataFrame(
        [(str(i), "Rp 1.000" if i else "x", f"{i + 1:02d}/01/2024", "t", None, None) for i in range(10)],
        "id string, debit string, day string, note string, saldo string, tanggal string",
    )
    out = infer_types(df)
    assert dict(out.dtypes) == {
        "id": "double", "debit": "double", "day": "timestamp_ntz", "note": "string",
        "saldo": "double", "tanggal": "timestamp_ntz",
    }
    assert out.filter("debit = 0").count() == 1


def test_fill_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "b", 5)], "id int, s string, n int")
    assert rows(fill_nulls(df, True, "z"), "id") == [(1, "z", None), (2, "b", 5)]
    assert rows(fill_nulls(df, {"n": 0, "s": "R_{id}_{q}"}), "id") == [(1, "R_1_{q}", 0), (2, "b", 5)]
    assert rows(fill_nulls(df, {"n": "none"}), "id")[0] == (1, None, "none")
    assert fill_nulls(df, "{bad json") is df and fill_nulls(df, False) is df


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(" a ",), ("a",), ("b\t",)], "v string")
    config = {"stripWhitespace": True, "deduplicate": True}
    once = clean(df, config)
    assert rows(once, "v") == [("a",), ("b",)] == rows(clean(once, config), "v")


# --- shaping ----------------------------------------------------------------------------------------


def test_transform_and_filter(spark):
    df = spark.createDataFrame([(1, 2, "x"), (0, 0, None)], "a int, b int, s string")
    out = transform(df, {"calculatedColumns": {"q": "b / a", "bad": "nope + 1"}, "rename": {"s": "t"}, "drop": "b"})
    assert out.columns == ["a", "t", "q"]
    assert rows(out, "a") == [(0, None, None), (1, "x", 2.0)]
    assert filter_rows(df, {"condition": "a == 1 and s in ['x']"}).count() == 1
    assert filter_rows(df, {"condition": "s != 'x'"}).count() == 1
    assert filter_rows(df, {"condition": "s <> 'x'"}).count() == 0
    assert filter_rows(df, {"condition": "no sense ("}).count() == 2
    assert filter_rows(df, {"filterCondition": "LIMIT 1"}).count() == 1
    assert filter_rows(df, {}) is df


def test_categorize(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (15.0,), (20.0,), (None,), (float("nan"),)], "v double")
    out = categorize(df, {"field": "v", "categories": [
        {"label": "low", "min": 0, "max": 10}, {"label": "mid", "min": 10, "max": 20}, {"min": 15, "max": 18}]})
    assert [r.v_tier for r in out.collect()] == ["low", "mid", "15-18", "Unknown", "Unknown", "Unknown"]
    lines = categorize(df, {"categorizeField": "v", "categories": "Low: v < 12\nHigh: v >= 12"})
    assert [r.v_tier for r in lines.collect()][:4] == ["Low", "Low", "High", "High"]
    assert categorize(df, {"field": "zz", "categories": []}) is df


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,), (1,)], "v int")
    assert [r.v for r in sort_rows(df, {"by": "v"}).collect()] == [1, 1, 2, None]
    assert [r.v for r in sort_rows(df, {"sortField": "v", "sortDirection": "DESC"}).collect()] == [2, 1, 1, None]
    with pytest.raises(ValueError):
        sort_rows(df, {"by": "nope"})


def test_aggregate(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", None), (None, 5.0), ("a", float("nan"))], "k string, v double")
    out = aggregate(df, {"groupBy": "k, zz", "aggregations": "s = SUM(v)\nn = COUNT(*)\nc = COUNT(v)\nq = MEDIAN(v)"})
    assert rows(out, "k") == [("a", 1.0, 3, 1), ("b", 0.0, 1, 0)]
    assert rows(aggregate(df, {"aggregations": {"n": "* COUNT", "m": "v MAX"}})) == [(5, 5.0)]
    assert aggregate(df, {"groupBy": "k", "aggregations": "x = SUM(zz)"}) is df
    assert aggregate(df, {"groupBy": "zz", "aggregations": "x = SUM(v)"}) is df
    with pytest.raises(ValueError):
        aggregate(df, {"groupBy": "k", "aggregations": "x = SUM(k)"})
    assert parse_aggregations("t = SUM(My Col)") == [("t", "SUM", "My Col")]


def test_pivot(spark):
    df = spark.createDataFrame([("r", "x", 1), ("r", "x", 2), ("r", "y", 5), ("s", "y", 1)], "a string, b string, v int")
    out = pivot(df, {"pivotRows": "a", "pivotColumns": "b", "pivotValues": "v"})
    assert out.columns == ["a", "x", "y"] and rows(out, "a")[0] == ("r", 3, 5)


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "A"), (None, "N"), (3, "C")], "k int, v string")
    full = {(1, "a", "A"), (None, "n", "N"), (2, "b", None), (3, None, "C")}
    for how, want in (
        ("left", full - {(3, None, "C")}), ("RIGHT", full - {(2, "b", None)}), ("FULL", full),
        ("inner", {(1, "a", "A"), (None, "n", "N")}),
    ):
        out = join(a, b, {"joinType": how, "joinKey": "k"})
        assert out.columns == ["k", "v_x", "v_y"] and set(rows(out)) == want
    with pytest.raises(ValueError):
        join(a, b, {"type": "cross"})


@pytest.mark.parametrize("how", ["right", "full"])
def test_a_frequent_key_is_split_in_joins(spark, how):
    a = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    b = spark.range(0, 3000, 1, 2).select((F.col("id") - 10).alias("k"), F.col("id").alias("w"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = join(a, b, {"joinType": how, "joinKey": "k"})
        got = rows(out)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    left = {}
    for k, v in rows(a):
        left.setdefault(k, []).append(v)
    right = dict(rows(b))
    want = [(k, v, w) for k, w in right.items() for v in left.get(k, [None])]
    want += [(k, v, None) for k, vs in left.items() if k not in right for v in vs] if how == "full" else []
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "skew=true" in plan and "RightOuter" not in plan and "FullOuter" not in plan


def test_upsert_rows(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, old int")
    b = spark.createDataFrame([(2, None, "x"), (3, "c", "y")], "K int, v string, new string")
    out = upsert_rows(t, b, ["k"])
    want = {(1, "a", 1, None), (2, None, 2, "x"), (None, "n", 3, None), (3, "c", None, "y")}
    assert set(rows(out)) == want == set(rows(upsert_rows(out, b, ["k"])))
    keys_only = upsert_rows(t, b.select("K"), ["k"])
    assert set(rows(keys_only)) == {(1, "a", 1), (2, "b", 2), (None, "n", 3), (3, None, None)}


def test_hot_key_plans_have_no_single_task_group(spark):
    """A frequent value must not be gathered by a window over it."""
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    out = validate(df, {"rules": "UNIQUE:k"})
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter(f"{K.ISSUES} != 'PASS'").count() == 334
    plan = join(df, df, {"type": "outer", "on": "k"})._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_latest_search_page(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "Y"), ("b", 2, "z")], "k string, t int, v string")
    assert rows(latest_per_key(df, ["k"], ["t"]), "k") == [("a", 3, "Y"), ("b", 2, "z")]
    assert rows(search_rows(df, "y")) == [("a", 3, "Y")]
    assert rows(page(df, [F.col("t")], 2, 2)) == [("a", 3, "Y")]


# --- analytics ---------------------------------------------------------------------------------------


def test_quantiles_order_all_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf")]
    rows = [(v,) for v in [values[7], -0.0, *values[:4], *values[5:7], *values[8:]]] + [(None,), (float("nan"),)]
    got = Q.exact_quantiles(spark.createDataFrame(rows, "v double"), {"v": F.col("v")}, [i / 9 for i in range(10)])["v"]
    assert (got.count, got.values) == (10, values)


def test_quantiles_descend_into_full_bins(spark):
    # Over 65536 rows share the leading 16, 32 and 48 bits.
    df = spark.range(0, 300_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 1 + F.pmod(F.hash("id"), F.lit(5000)) * F.lit(2.0**-52))
        .otherwise(1 + F.col("id") * F.lit(2.0**-44)).alias("v"))
    data = sorted(r.v for r in df.collect())
    probs = [0.0, 1 / 3, 0.4, 0.6, 0.9, 1.0]
    got = Q.exact_quantiles(df, {"v": F.col("v"), "minus": -F.col("v")}, probs)
    for p, value, mirrored in zip(probs, got["v"].values, got["minus"].values, strict=True):
        at = (len(data) - 1) * p
        low, high = data[math.floor(at)], data[math.ceil(at)]
        assert value == low + (high - low) * (at - math.floor(at))
        at = (len(data) - 1) * (1 - p)
        assert -mirrored == pytest.approx(data[round(at)], rel=1e-9)
    plan = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert Q.exact_quantiles(plan, {"a": F.lit(None), "b": F.col("v")}, [0.5])["a"] == Q.Quantiles(0, [None])


def test_two_hundred_quantiles_at_once(spark):
    df = spark.range(0, 50_000, 1, 4)
    names = {f"v{i}": (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000_003)) / 7) for i in range(50)}
    got = Q.exact_quantiles(df, names, [0.1, 0.25, 0.5, 0.75])
    for n in ("v0", "v49"):
        assert got[n].values == pytest.approx(df.select(F.percentile(names[n], F.array(*map(F.lit, [0.1, 0.25, 0.5, 0.75])))).first()[0], rel=1e-12)


def test_exact_quantiles_against_sorting(spark):
    # A third of all rows hold one value.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.pmod(F.hash("id"), F.lit(100000)) / 7).alias("v"))
    data = sorted(r.v for r in df.collect())
    got = Q.exact_quantiles(df, {"v": F.col("v")}, [0.0, 0.25, 0.5, 0.9, 1.0])["v"]
    for p, value in zip([0.0, 0.25, 0.5, 0.9, 1.0], got.values, strict=True):
        at = (len(data) - 1) * p
        low = data[int(at)]
        high = data[min(int(at) + 1, len(data) - 1)]
        assert value == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    empty = Q.exact_quantiles(df.limit(0), {"v": F.col("v")}, [0.5])["v"]
    assert (empty.count, empty.values) == (0, [None])


def test_many_quantiles_beside_a_hot_value(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 990, -1.0 - F.col("id")).when(F.col("id") < 2500, 0.0).otherwise(F.col("id") / 3).alias("v"))
    data = sorted(r.v for r in df.collect())
    names = [f"v{i}" for i in range(10)]
    probs = [0.25, 0.2475, 0.62, 0.75]
    got = Q.exact_quantiles(df, {n: F.col("v") + i for i, n in enumerate(names)}, probs)
    for i, n in enumerate(names):
        for p, value in zip(probs, got[n].values, strict=True):
            at = (len(data) - 1) * p
            low, high = data[int(at)] + i, data[min(int(at) + 1, len(data) - 1)] + i
            assert value == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_quality(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 150.0), (4, 180.0), (5, 5000.0)], "id int, sales double")
    row = quality(df).first()
    assert row.completeness == 100.0 and 0 <= row.score <= 100 and row.accuracy == 90.0
    assert quality(df.limit(0)).first().score == 100.0
    swapped = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert quality(swapped).first().uniqueness == 66.67


def test_insights(spark):
    df = spark.createDataFrame(
        [(100, 20, "A"), (200, 40, "A"), (150, 30, "B"), (300, 60, "A"), (250, 50, "B")],
        "sales int, profit int, category string")
    facts = {(r.kind, r.column, r.column2): r.value for r in insights(df).collect()}
    assert facts["correlation", "sales", "profit"] == pytest.approx(1.0)
    assert facts["category", "category", "A"] == 3 and facts["mean", "sales", None] == 200
    assert len(narratives(df)) == 5


def test_anomaly(spark):
    df = spark.createDataFrame([(v,) for v in [100, 105, 98, 102, 10000]], "amount int")
    for method in ("isolation_forest", "zscore"):
        out = detect_anomalies(df, {"method": method})
        label = {r.amount: r[K.ANOMALY_LABEL] for r in out.collect()}
        if method == "isolation_forest":
            assert label[10000] == "ANOMALY" and label[100] == "NORMAL"
    z = detect_anomalies(df, {"method": "zscore"}).filter("amount = 10000").first()
    assert z[K.ANOMALY_SCORE] == pytest.approx(0.5963, abs=1e-4) and z[K.ANOMALY_LABEL] == "SUSPICIOUS"
    none = detect_anomalies(spark.createDataFrame([("x",)], "s string"), {})
    assert rows(none) == [("x", 0.0, "NORMAL")]


def test_forest_share_and_planted_outliers(spark):
    df = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") < 20, 50.0).otherwise(F.randn(1)).alias("x"), F.randn(2).alias("y"))
    df = spark.createDataFrame(df.collect(), df.schema)
    out = detect_anomalies(df, {"columns": ["x", "y"]})
    found = [r.id for r in out.filter(f"{K.ANOMALY_LABEL} = 'ANOMALY'").collect()]
    assert len(found) == pytest.approx(200, abs=25) and set(range(20)) <= set(found)
    ends = out.agg(F.min(K.ANOMALY_SCORE), F.max(K.ANOMALY_SCORE)).first()
    assert ends[0] == 0.0 and ends[1] == pytest.approx(1.0, abs=1e-3)


def test_every_tree_of_a_forest_has_its_share_of_rows(spark):
    for total, least in ((50, 50), (1000, 256), (30_000, 256)):
        features = spark.range(0, total, 1, 3).select((F.col("id") * 1.0).alias("f0"))
        forest = anomaly._grow(features, total, 7)
        assert [t["tree"] for t in forest] == list(range(anomaly.TREES))
        assert {t["size"][0] for t in forest} == {least}
        # Trees are drawn apart from one another.
        assert total <= 256 or len({t["cut"][0] for t in forest}) == anomaly.TREES


def test_forecast(spark):
    days = [(datetime(2024, 1, d), 10.0 + 2 * d) for d in range(1, 11)]
    df = spark.createDataFrame(days, "day timestamp_ntz, sales double")
    out = forecast(df, {"horizon": 2})
    new = rows(out.filter("sales is null"), "day")
    assert new == [(datetime(2024, 1, 11), None, 32.0, 32.0, 32.0), (datetime(2024, 1, 12), None, 34.0, 34.0, 34.0)]
    assert out.filter("sales is not null").count() == 10
    assert forecast(df.limit(2), {}).columns == ["day", "sales"]
    text = df.select(F.date_format("day", "dd/MM/yyyy").alias("day"), "sales")
    assert forecast(text, {"dateColumn": "day", "targetColumn": "sales", "horizon": 1}).count() == 11


def test_trend_with_one_date_on_most_rows(spark):
    import numpy as np

    data = [(datetime(2024, 1, 1 + (i % 9 if i % 3 else 4)), float((i * 7919) % 101)) for i in range(600)]
    df = spark.createDataFrame(data, "at timestamp_ntz, y double")
    count, last, slope, intercept, error = fit_trend(df)
    y = np.array([v for _, v in sorted(data)])
    line = np.polyfit(np.arange(len(y)), y, 1)
    assert (count, last) == (600, datetime(2024, 1, 9))
    assert (slope, intercept) == (pytest.approx(line[0]), pytest.approx(line[1]))
    assert error == pytest.approx(np.std(y - np.polyval(line, np.arange(len(y)))))


def test_classify(spark):
    texts = ["Pelayanan sangat bagus dan mantap", "Produk jelek dan rugi", "Biasa saja", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, review string")
    out = classify(df, {"textColumn": "review"})
    assert [r.sentiment_label for r in out.orderBy("id").collect()] == ["POSITIF", "NEGATIF", "NETRAL", "NETRAL"]
    assert classify(df, {"textColumn": "nope"}) is df
    assert classify(df, {"textColumn": "review", "mode": "m"}).columns[-1] == "m_label"


# --- dashboards and governance -------------------------------------------------------------------------


def test_bi(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), (None, None)], "k string, v int")
    assert rows(bi.chart(df, {"xField": "k", "yField": "v", "aggregation": "SUM"})) == [(None, None), ("b", 5), ("a", 1)]
    assert rows(bi.chart(df, {"type": "LINE", "xField": "k"})) == [("a", 1), ("b", 1), (None, 1)]
    assert bi.kpi(df, {"aggregation": "COUNT"}).columns == ["count"]
    with pytest.raises(ValueError):
        bi.kpi(df, {"kpiField": "v", "aggregation": "median"})
    assert rows(bi.distinct_values(df, "k", 1)) == [("a",)]
    assert set(bi.auto_widgets(df.selectExpr("v", "k as region"), "deep")) == {
        "Total v", "v by region", "region Distribution"}
    assert not bi.is_select_only("select 1; drop table x") and not bi.is_select_only("with a as (select 1) select 1")
    assert bi.query(spark, "SELECT * FROM t", t=spark.range(50)).count() == 20
    with pytest.raises(ValueError):
        bi.query(spark, "DELETE FROM t")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(path)
    df = bi.apply_filters(spark.read.parquet(path), [{"field": "id", "operator": "GREATER_THAN", "value": "5"}])
    assert df.count() == 5
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_masking(spark):
    df = spark.createDataFrame([
        ("abc@x.id", "123456", "123456789", "12345678901"), ("ab@x.id", "1234567", "1234567890", "1234 5678-9012"),
        ("a@x.id", " 081234567890 ", None, None), ("none", None, "", ""),
    ], "email string, phone string, nik string, card string")
    assert rows(governance.mask_dataset(df)) == [
        ("a*c@x.id", "123456", "123456789", "12345678901"),
        ("a*@x.id", "1234****4567", "1234******", "1234-****-****-9012"),
        ("a*@x.id", "0812****7890", None, None), ("none", None, "", ""),
    ]


def test_metrics_without_runs(spark):
    empty = spark.createDataFrame([], "tenantId int, status string, duration double, rowsOutput long")
    got = dict(rows(governance.metrics(empty, empty, empty, empty)))
    assert got == {n: 100 if n == "PIPELINE_SUCCESS_RATE" else 0 for n in governance.METRICS}
    with pytest.raises(ValueError):
        governance.metric("NOPE", empty, empty, empty, empty)


def test_quarantine_sample(spark):
    from terrace.operators.validate import quarantine_record

    rejected = spark.createDataFrame([(i, None) for i in range(60)], "id int, v string")
    row = quarantine_record(rejected, 60, "why", F.lit(datetime(2024, 1, 1))).first()
    sample = json.loads(row.failed_data)
    assert row.reason == "why (60 rows)" and len(sample) == 50 and sample[0].keys() == {"id", "v"}


def test_board_equals_its_widgets_in_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    widgets = {
        "sum": {"kpiField": "o_totalprice"}, "none": {"kpiField": "o_totalprice", "filterField": "o_custkey", "filterValue": "-5"},
        "count none": {"aggregation": "COUNT", "filterField": "o_custkey", "filterValue": "-5"},
        "bars": {"type": "BAR", "xField": "o_orderpriority"}, "status": {"type": "BAR", "xField": "o_orderstatus", "yField": "o_totalprice", "aggregation": "AVG"},
        "few": {"type": "PIE", "xField": "o_orderpriority", "filterField": "o_orderstatus", "filterValue": "F"},
    }
    out = bi.board(df, widgets)
    want = []
    for title, cfg in widgets.items():
        for r in bi.widget(df, {"type": "KPI", **cfg}).collect():
            want.append((title, r[0] if len(r) > 1 else None, None if r[-1] is None else pytest.approx(float(r[-1]), rel=1e-12)))
    got = sorted(rows(out), key=str)
    assert len(got) == len(want) and all(any(g[:2] == w[:2] and g[2] == w[2] for w in want) for g in got)
    assert bi.board(df, widgets)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted(rows(bi.board(df.limit(0), widgets)), key=str) == [("count none", None, 0.0), ("none", None, None), ("sum", None, None)]
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "l string, v int")
    assert set(rows(bi.board(nulls, {"c": {"type": "PIE", "xField": "l", "yField": "v", "aggregation": "SUM"}}))) == {("c", None, 3.0), ("c", "a", 3.0)}
    for wrong in ({"type": "TABLE"}, {"kpiField": "l", "aggregation": "MAX"}):
        with pytest.raises(ValueError):
            bi.board(nulls, {"w": wrong})


def test_table_counts(spark):
    df = spark.createDataFrame([(None, 1), ("", None), ("a", None)], "rows string, nulls int")
    assert rows(bi.table_counts(df)) == [("rows", 1, 3, 2, 1), ("nulls", 2, 3, 2, 2)]
    assert rows(bi.table_counts(df.limit(0))) == [("rows", 1, 0, 2, 0), ("nulls", 2, 0, 2, 0)]


def test_correlations_over_present_pairs(spark):
    draw = random.Random(8)
    data = []
    for i in range(500):
        a, b = draw.gauss(1e6, 3), draw.random()
        cells = [a, 2 * a + draw.gauss(0, 1), b, -b, 5.0, 0.1, float("inf") if i == 9 else b, None, float(i) if i < 1 else None]
        data.append(tuple(None if draw.random() < 0.1 and k not in (4, 8) else v for k, v in enumerate(cells)))
    names = [f"x{k}" for k in range(9)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r[0], r[1]): r[2] for r in correlations(df).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        both = [(row[i], row[j]) for row in data if row[i] is not None and row[j] is not None]
        if len(both) < 2:
            assert r is None
        elif any(math.isinf(v) for pair in both for v in pair) or len({x for x, _ in both}) == 1 or len({y for _, y in both}) == 1:
            assert math.isnan(r)
        else:
            assert r == pytest.approx(statistics.correlation(*map(list, zip(*both))), abs=1e-9)
    assert "Generate" not in correlations(df)._jdf.queryExecution().executedPlan().toString()
    assert correlations(df.select("x0")).collect() == [] and correlations(df.limit(0)).collect() == []


def test_correlations_of_a_hundred_columns(spark):
    df = spark.range(0, 2000, 1, 4).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) + F.col("id") * (i % 2)).cast("double").alias(f"c{i}") for i in range(100)])
    got = {(r[0], r[1]): r[2] for r in correlations(df).collect()}
    assert len(got) == 4950
    for a, b in (("c0", "c1"), ("c1", "c99"), ("c50", "c98")):
        assert got[a, b] == pytest.approx(df.select(F.corr(a, b)).first()[0], abs=1e-10)
