"""User expressions and user SQL: what computes is let through, what reaches further is refused."""

import pytest
from pyspark.sql import functions as F

from terrace.functions.guard import Refused, check_expression, check_query
from terrace.operators import bi
from terrace.operators.transform import categorize, filter_rows, transform

PLAIN = [
    "a + 1 > 2 AND b LIKE 'x%'", "CASE WHEN a IN (1, 2) THEN upper(b) ELSE concat(b, '{x}') END", "coalesce(a, 0) / nullif(a, 0)",
    "transform(array(a), v -> v + 1)[0]", "CAST(b AS date) + INTERVAL 1 DAY", "extract(year FROM current_date())", "a BETWEEN 1 AND 2",
    "sum(a) OVER (PARTITION BY b ORDER BY a)", "regexp_replace(b, '[0-9]+', '')", "get_json_object(b, '$.reflect')", "'reflect(1)' = b", "`reflect`",
]
BEYOND = [
    "reflect('java.lang.System', 'exit', 1)", "java_method('java.lang.System', 'getProperty', 'user.dir')", "try_reflect('java.lang.System', 'getenv')",
    "a + length(REFLECT('java.lang.System', 'getProperty', 'user.dir'))", "a IN (SELECT 1)", "EXISTS (SELECT * FROM parquet.`/x`)", "(SELECT max(x) FROM t)",
    "input_file_name()", "current_user()", "no_such_function(a)", "transform(array(a), v -> java_method('java.lang.Math', 'abs', v))", "spark_catalog.default.f(a)",
    "CASE WHEN true THEN raise_error('x') END", "count(a) FILTER (WHERE reflect('java.lang.System', 'gc') IS NULL)",
]
QUERIES = [
    "SELECT a, count(*) AS n FROM t WHERE b <> '{' GROUP BY a HAVING count(*) > 0 ORDER BY n LIMIT 5", "SELECT * FROM t x JOIN u y ON x.a = y.a",
    "SELECT * FROM (SELECT a FROM t UNION ALL SELECT a FROM u) v", "SELECT a FROM t WHERE a IN (SELECT a FROM u)", "SELECT * FROM t LATERAL VIEW explode(array(a)) w AS e",
    "SELECT (WITH c AS (SELECT max(a) AS m FROM t) SELECT m FROM c) AS m", "SELECT 1 AS one", "SELECT * FROM VALUES (1, 'x') AS v(a, b)", "SELECT DISTINCT b FROM T",
]
REFUSED = [
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT * FROM t, text.`/etc/passwd`", "SELECT TRANSFORM(a) USING 'cat' FROM t", "SELECT * FROM range(5)",
    "SELECT a FROM t WHERE a IN (SELECT x FROM json.`/x`)", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT (SELECT max(a) FROM other) AS m",
    "SELECT a FROM t ORDER BY java_method('java.lang.Math', 'abs', a)", "SELECT * FROM (WITH c AS (SELECT 1 AS x) SELECT * FROM d) e", "SELECT * FROM spark_catalog.default.t",
]


@pytest.fixture(scope="module")
def frames(spark):
    return {"t": spark.createDataFrame([(1, "x"), (2, "{y}")], "a int, b string"), "u": spark.createDataFrame([(1, "z")], "a int, b string")}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_expressions_pass(spark, text):
    assert check_expression(spark, text) == text


@pytest.mark.parametrize("text", BEYOND)
def test_other_expressions_are_refused(spark, text):
    with pytest.raises(Refused):
        check_expression(spark, text)


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_over_given_frames_run(spark, frames, sql):
    bi.query(spark, sql, **frames).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_other_queries_are_refused(spark, frames, sql):
    with pytest.raises(Refused):
        check_query(spark, sql, frames)
    with pytest.raises(ValueError):
        bi.query(spark, sql, **frames)


def test_session_views_stay(spark, frames):
    spark.range(3).createOrReplaceTempView("t")
    try:
        assert bi.query(spark, "SELECT b FROM t WHERE b = '{y}'", **frames).collect() == [("{y}",)]
        assert spark.table("t").columns == ["id"]
    finally:
        spark.catalog.dropTempView("t")


def test_steps_leave_refused_texts_out(spark):
    df = spark.createDataFrame([(1,), (5,)], "a int")
    bad = "reflect('java.lang.System', 'getProperty', 'user.dir')"
    assert transform(df, {"calculatedColumns": f"x = a + 1\ny = {bad}"}).columns == ["a", "x"]
    assert filter_rows(df, {"condition": f"a > 1 & {bad} != ''"}).count() == 2
    assert filter_rows(df, {"condition": "a > 1"}).count() == 1
    with pytest.raises(Refused):
        categorize(df, {"field": "a", "categories": f"odd: {bad} = '/'"})
    assert [r.a_tier for r in categorize(df, {"field": "a", "categories": "low: a < 3\nhigh: a >= 3"}).orderBy(F.col("a")).collect()] == ["low", "high"]
