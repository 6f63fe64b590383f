from datetime import datetime

import pytest

from terrace.plans.flow import apply_steps, check_gold, quarantine_table, run
from terrace.plans.templates import GOALS, TEMPLATES, template
from workload.compare import compare, oracle_connection
from workload.queries import QUERIES

from .conftest import SF

AT = datetime(2024, 1, 1)


def step(kind, order=0, **config):
    return {"type": kind, "order": order, "config": config}


def test_worked_example_in_three_layers(spark, lake, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("Status,amount,day\nA,Rp 1.000,01/02/2024\nA,Rp 2.000,02/02/2024\n B ,500,03/02/2024\nB,500,03/02/2024\n")
    steps = template("medallion", {
        "SOURCE": {"filePath": str(path)},
        "AGGREGATE": {"groupBy": "Status", "aggregations": "total = SUM(amount)\nn = COUNT(*)"},
    }, "sales")
    summary = run(lake, {"runId": 1, "pipelineId": 2, "steps": steps}, as_of=AT)
    assert [(o["layer"], o["rows"]) for o in summary["outputs"]] == [("bronze", 4), ("silver", 3), ("gold", 2)]
    gold = lake.read("gold", "gold_sales").orderBy("Status").collect()
    assert [(r.Status, r.total, r.n) for r in gold] == [("A", 3000.0, 2), ("B", 500.0, 1)]
    assert lake.catalog().count() == 3 and "step_errors" not in summary


def test_failing_steps_are_noted(spark, lake):
    steps = [
        step("SORT", 1, by="nope"), step("AGGREGATE", 2, groupBy="k", aggregations="s = SUM(k)"),
        step("WHATEVER", 3), step("JOIN", 4, source="silver.gone", on="k"),
        {**step("OUTPUT", 5), "outputLayer": "SILVER", "outputTable": "t"},
    ]
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    summary = run(lake, {"steps": steps}, df, AT)
    assert [e["step"] for e in summary["step_errors"]] == [1, 2, 4] and summary["rows"] == 2
    with pytest.raises(ValueError):
        run(lake, {"steps": [step("SOURCE", 1)]})


def test_gold_gate():
    out = {**step("OUTPUT", 2), "outputLayer": "GOLD", "outputTable": "t"}
    with pytest.raises(ValueError):
        check_gold([step("CLEAN", 1), out])
    for kind in ("AGGREGATE", "JOIN", "PIVOT"):
        check_gold([step(kind, 1), out])
    with pytest.raises(ValueError):
        check_gold([step("JOIN", 3), out])


def test_drop_mode_quarantines(spark, lake):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(8)], "id int, v string")
    steps = [step("VALIDATE", 1, rules="NOT_NULL:v", validationMode="drop"), step("INSIGHT", 2),
             {**step("OUTPUT", 3), "outputTable": "ok"}]
    summary = run(lake, {"steps": steps}, df, AT)
    assert summary["rows"] == 4 and summary["insights"]
    assert lake.read("silver", quarantine_table(0, 1)).count() == 4
    assert lake.read("silver", "_failed_rows").first().reason == "Validation rules dropped rows (4 rows)"
    flagged = run(lake, {"steps": steps, "source": {"category": "Keuangan / Finance"}}, df, AT)
    assert flagged["rows"] == 8


def test_upsert_and_join_steps(spark, lake):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    out = {**step("OUTPUT", 2, writeMode="upsert", primaryKey="id"), "outputTable": "t"}
    run(lake, {"steps": [out]}, base, AT)
    run(lake, {"steps": [out]}, spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), AT)
    got = lake.read("silver", "t").orderBy("id")
    assert [r.v for r in got.collect()] == ["a", "B", "c"]
    joined = apply_steps(base, [step("JOIN", 1, joinType="INNER", joinKey="id", joinSource="t")], lake.find)
    assert joined.orderBy("id").first().v_y == "a"
    from_table = run(lake, {"source": {"sourceTable": "t", "sourceLayer": "SILVER"},
                            "steps": [step("SOURCE", 1), {**step("OUTPUT", 2), "outputTable": "copy"}]})
    assert from_table["rows"] == 3


def test_templates():
    assert len(TEMPLATES) == 10 and len(GOALS) == 4
    for name in [*TEMPLATES, *GOALS]:
        steps = template(name, table="t")
        check_gold(steps)
        assert steps[0]["type"] == "SOURCE" and steps[-1]["type"] == "OUTPUT"
    with pytest.raises(ValueError):
        template("nope")


def test_top_ten_template(spark):
    df = spark.createDataFrame([(str(i % 30), float(i)) for i in range(300)], "k string, amount double")
    steps = template("gold-top10", {"AGGREGATE": {"groupBy": "k", "aggregations": "t = SUM(amount)"},
                                    "CLEAN": {"autoTypeInference": False}, "SORT": {"sortField": "t"}})
    out = apply_steps(df, [s for s in steps if s["type"] not in ("SOURCE", "OUTPUT")])
    assert [r.k for r in out.collect()] == [str(k) for k in range(29, 19, -1)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    outcome = compare(spark, oracle_connection(SF), name, SF)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_no_gold_table_after_a_failed_summary(spark, lake):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    good = [step("AGGREGATE", 1, groupBy="k", aggregations="s = SUM(k)\nt = SUM(n)"),
            {**step("OUTPUT", 2), "outputLayer": "GOLD", "outputTable": "g"}]
    run(lake, {"steps": good}, df, AT)
    assert [(r.k, r.t) for r in lake.read("gold", "g").collect()] == [("a", 3)]
    bad = [step("AGGREGATE", 1, groupBy="k", aggregations="s = SUM(k)"),
           {**step("OUTPUT", 2), "outputLayer": "GOLD", "outputTable": "h"}]
    with pytest.raises(ValueError, match="no gold table"):
        run(lake, {"steps": bad}, df, AT)
    assert not lake.exists("gold", "h")
