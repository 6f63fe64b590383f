import json
from datetime import datetime
from pathlib import Path

import pytest

from terrace.sources import export
from terrace.sources.database import jdbc_options
from terrace.sources.files import landed_format, read_csv, read_records, record_columns
from terrace.sources.lake import describe_tables, preview, source_profile, table_schema


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_bad_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n3\n4,5,6\n7,8,\n\"x,y\",9\n")
    df = read_csv(spark, path)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [("1", "2"), ("3", None), ("x,y", "9")], key=str
    )
    # Field counts must be judged on whole rows even when few columns are asked for.
    assert df.count() == 3
    assert sorted(r.a for r in df.select("a").collect()) == ["1", "3", "x,y"]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separator(spark, tmp_path, sep):
    path = write(tmp_path / "a.csv", f"x{sep}y\n1{sep}2\n3{sep}4\n")
    assert [tuple(r) for r in read_csv(spark, path).orderBy("x").collect()] == [("1", "2"), ("3", "4")]


def test_csv_latin1_and_repeated_names(spark, tmp_path):
    path = write(tmp_path / "a.csv", "naïve,b,b\né,1,2\n", "latin-1")
    df = read_csv(spark, path)
    assert df.columns == ["naïve", "b", "b.1"]
    assert df.collect()[0][0] == "é"


def test_records(spark, tmp_path):
    data = [{"Id": 1, "2nd": {"k": [1, 2]}}, {"Id": None, "Last Name": "x"}]
    path = write(tmp_path / "r.json", json.dumps(data))
    assert landed_format(spark, path) == "json"
    df = read_records(spark, path)
    assert df.columns == ["Id", "2nd", "Last Name"]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0][0] == "1" and json.loads(rows[0][1]) == {"k": [1, 2]} and rows[0][2] is None
    assert rows[1] == (None, None, "x")
    assert record_columns(df).columns == ["id", "col_2nd", "last_name"]
    one = write(tmp_path / "o.json", '{"a": 1}')
    assert [tuple(r) for r in read_records(spark, one).collect()] == [("1",)]
    many = write(tmp_path / "l.json", '{"a": 1}\n{"a": 2, "b": true}\n')
    assert sorted(map(tuple, read_records(spark, many, lines=True).collect())) == [
        ("1", None), ("2", "true")
    ]


def test_bronze_ingest(spark, lake, tmp_path):
    path = write(tmp_path / "s.csv", "id,amount\n1,5\n2,\n")
    at = datetime(2024, 1, 2)
    table, rows, columns = lake.ingest(read_csv(spark, path), 7, at)
    assert (table, rows) == ("csv_7", 2)
    assert columns == [{"name": "id", "type": "TEXT"}, {"name": "amount", "type": "TEXT"}]
    got = lake.read("bronze", "csv_7").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "5", at, 7), ("2", None, at, 7)]
    assert lake.ingest(spark.createDataFrame([], "a string"), 8) == ("", 0, [])
    name, n = lake.ingest_records(spark.createDataFrame([("x",)], "a string"), 3, at)
    assert (name, n) == ("api_3_20240102000000", 1)
    assert lake.ingest_extract(spark.range(3), 9) == ("ext_db_9", 3)
    assert lake.ingest_extract(spark.range(2), 9) == ("ext_db_9", 2)


def test_overwrite_keeps_three_backups(spark, lake):
    for n in range(1, 7):
        assert lake.write(spark.range(n), "SILVER", "T") == n
    assert lake.read("silver", "t").count() == 6
    assert len(lake.snapshots("silver", "t")) == 4


def test_unfinished_snapshot_is_not_seen(spark, lake):
    lake.write(spark.range(2), "silver", "t")
    broken = lake._new_snapshot("silver", "t")
    lake._save_schema(broken, spark.range(1).schema)
    assert lake.read("silver", "t").count() == 2


def test_append_evolves(spark, lake):
    lake.overwrite(spark.createDataFrame([(1, "a")], "id int, v string"), "silver", "t")
    n = lake.append(spark.createDataFrame([("2", 5)], "ID string, w int"), "silver", "t")
    assert n == 1
    rows = lake.read("silver", "t").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, None, 5)]


def test_upsert(spark, lake):
    first = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, old int")
    lake.upsert(first, "silver", "t", ["id"])
    batch = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, v string, extra string")
    lake.upsert(batch, "silver", "t", ["ID"])
    want = [(1, "a", 10, None), (2, None, 20, "n"), (3, "c", None, "m")]
    assert [tuple(r) for r in lake.read("silver", "t").orderBy("id").collect()] == want
    lake.upsert(batch, "silver", "t", ["id"])
    assert [tuple(r) for r in lake.read("silver", "t").orderBy("id").collect()] == want
    with pytest.raises(ValueError):
        lake.upsert(batch.union(batch), "silver", "t", ["id"])
    lake.upsert(batch, "silver", "t", ["nope"])
    assert lake.read("silver", "t").count() == 5


def test_write_hardens_and_stamps(spark, lake):
    df = spark.createDataFrame([("Rp 1.000", "05/01/2024", "x")], "total_amount string, tanggal string, note string")
    at = datetime(2024, 5, 6)
    lake.write(df, "silver", "t", context={"run_id": 3, "pipeline_id": 4}, as_of=at)
    row = lake.read("silver", "t").first().asDict()
    assert row == {
        "total_amount": 1000.0, "tanggal": datetime(2024, 1, 5), "note": "x",
        "_etl_timestamp": at, "_pipeline_run_id": 3, "_source_pipeline_id": 4,
    }


def test_metadata(spark, lake):
    lake.write(spark.range(4), "silver", "t")
    rows = lake.discover().collect()
    assert [(r.table_name, r.column_count, r.row_count) for r in rows] == [("silver.t", 2, 4)]
    lake.register([{"layer": "silver", "table": "my_table", "rows": 4, "columns": []}])
    lake.register([{"layer": "silver", "table": "my_table", "rows": 9, "columns": []}])
    row = lake.catalog().collect()
    assert [(r.layer, r.displayName, r.rowsCount) for r in row] == [("SILVER", "My Table", 9)]
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert [(r.name, r.type) for r in table_schema(df).orderBy("position").collect()] == [
        ("i", "INTEGER"), ("d", "DECIMAL"), ("s", "VARCHAR"), ("b", "BOOLEAN")
    ]
    assert tuple(source_profile(df).first()) == (1, 4)
    shown, total = preview(spark.range(250), ["id"])
    assert shown.count() == 100 and total.first().total == 250
    assert describe_tables(spark, {}).count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', None), (2, "a,b", "z")], "i int, s string, n string")
    export.export_table(df, str(tmp_path / "c"), "csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert '"1","say ""hi""",""' in text and '"2","a,b","z"' in text and '"i","s","n"' in text
    export.export_table(df, str(tmp_path / "t"), "tsv", limit=1)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 1
    export.export_table(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    export.archive(df, str(tmp_path / "p"))
    assert list((tmp_path / "p").glob("*.snappy.parquet"))
    folders = export.export_dashboard(
        {"gold/x": df},
        [{"type": "KPI", "title": "Sum", "dataSource": "gold/x", "xField": "i", "yField": "SUM"},
         {"type": "TABLE", "title": "Rows", "dataSource": "gold/x"},
         {"type": "TABLE", "title": "Gone", "dataSource": "gold/y"}],
        str(tmp_path / "d"),
    )
    assert len(folders) == 2
    assert spark.read.option("header", True).csv(folders[0]).first()[0] == "3"


def test_jdbc_options():
    base = {"dbType": "mysql", "host": "h", "database": "d", "sqlQuery": "select 1;"}
    o = jdbc_options(base)
    assert o["url"] == "jdbc:mysql://h:3306/d" and o["query"] == "select 1"
    o = jdbc_options({**base, "dbType": "POSTGRESQL", "partitionColumn": "id", "lowerBound": 0,
                      "upperBound": 9, "numPartitions": 3})
    assert o["dbtable"] == "(select 1) extract" and o["numPartitions"] == "3" and "query" not in o
    for bad in ({**base, "dbType": "x"}, {**base, "sqlQuery": ""}, {**base, "lowerBound": 1}):
        with pytest.raises(ValueError):
            jdbc_options(bad)


def test_streams(spark, lake, tmp_path):
    from terrace.streaming.ingest import append_stream, landed_files, upsert_stream

    landing = tmp_path / "in"
    landing.mkdir()
    write(landing / "1.csv", "id,v\n1,a\n2,b\n")
    mark = str(tmp_path / "cp")
    for rows, extra in ((2, None), (3, "id,v\n2,c\n7,8,9\n")):
        if extra:
            write(landing / "2.csv", extra)
        stream = landed_files(spark, str(landing), ["id", "v"], 5)
        append_stream(stream, lake, "bronze", "landed", mark).awaitTermination()
        assert lake.read("bronze", "landed").count() == rows
    stream = landed_files(spark, str(landing), ["id", "v"], 5, maxFilesPerTrigger="1")
    upsert_stream(stream.drop("_ingested_at"), lake, "silver", "s", ["id"], str(tmp_path / "cp2"),
                  order=["v"]).awaitTermination()
    assert sorted(tuple(r)[:2] for r in lake.read("silver", "s").collect()) == [("1", "a"), ("2", "c")]


def test_malformed_array_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    assert read_records(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.json").write_text('[{"a":3},{"a":4')
    with pytest.raises(Exception, match="malformed JSON"):
        read_records(spark, str(tmp_path)).collect()


def test_export_without_limit_writes_all(spark, tmp_path):
    export.export_table(spark.range(120_000), str(tmp_path / "all"), limit=None)
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 120_000


def test_append_and_upsert_lose_no_values(spark, lake):
    lake.overwrite(spark.createDataFrame([(1, 5)], "id int, n int"), "silver", "t")
    for bad in ("abc", "7.5"):
        batch = spark.createDataFrame([(1, bad)], "id int, n string")
        with pytest.raises(Exception, match="not of type int"):
            lake.append(batch, "silver", "t")
        with pytest.raises(Exception, match="not of type int"):
            lake.upsert(batch, "silver", "t", ["id"])
    assert [tuple(r) for r in lake.read("silver", "t").collect()] == [(1, 5)]
    assert lake.append(spark.createDataFrame([(2, 5_000_000_000)], "id int, n bigint"), "silver", "t") == 1
    assert lake.append(spark.createDataFrame([(3, 0.5)], "id int, n double"), "silver", "t") == 1
    lake.upsert(spark.createDataFrame([(1, "6")], "id int, n string"), "silver", "t", ["id"])
    got = lake.read("silver", "t").orderBy("id")
    assert dict(got.dtypes)["n"] == "double"
    assert [tuple(r) for r in got.collect()] == [(1, 6.0), (2, 5e9), (3, 0.5)]
    with pytest.raises(Exception, match="not of type double"):
        lake.append(spark.createDataFrame([(4, 2**53 + 1)], "id int, n bigint"), "silver", "t")


def test_append_adds_its_own_files_only(spark, lake):
    lake.overwrite(spark.range(2), "silver", "t")
    before = lake.read("silver", "t")
    old = set(before.inputFiles())
    assert lake.append(spark.range(3), "silver", "t") == 3
    assert lake.append(spark.range(4), "silver", "t") == 4
    assert lake.append(spark.range(0), "silver", "t") == 0
    assert before.count() == 2 and lake.read("silver", "t").count() == 9
    assert old < set(lake.read("silver", "t").inputFiles()) and len(lake.snapshots("silver", "t")) == 1
    failing = spark.range(1).selectExpr("cast(raise_error('no') as bigint) as id", "1 as more")
    with pytest.raises(Exception, match="no"):
        lake.append(failing, "silver", "t")
    assert lake.read("silver", "t").count() == 9 and lake.read("silver", "t").columns == ["id"]
    for n in range(1, 6):
        lake.overwrite(spark.range(n), "silver", "t")
    assert len(lake.snapshots("silver", "t")) == 4
    assert lake.append(spark.range(5), "silver", "t") == 5 and lake.read("silver", "t").count() == 10


def test_streams_and_batches_share_a_table(spark, lake, tmp_path):
    from terrace.streaming.ingest import append_stream, landed_files

    landing, marks = tmp_path / "in", [str(tmp_path / "c1"), str(tmp_path / "c2")]
    landing.mkdir()
    write(landing / "1.csv", "id,v\n1,a\n2,b\n")
    for n in range(12):  # past the batch at which the sink's log is compacted
        if n:
            write(landing / f"{n + 1}.csv", f"id,v\n{n + 2},x\n")
        append_stream(landed_files(spark, str(landing), ["id", "v"], 5).drop("_ingested_at"), lake, "bronze", "t", marks[0]).awaitTermination()
    assert lake.read("bronze", "t").count() == 13 and lake.tables() == [("bronze", "t")]
    # Files without an entry in the sink's log, as a failed batch leaves them, are not read.
    lake.read("bronze", "t").write.mode("append").parquet(str(tmp_path / "stray"))
    stray = next((tmp_path / "stray").glob("part-*"))
    (Path(lake.landings("bronze", "t")[0].removeprefix("file:")) / stray.name).write_bytes(stray.read_bytes())
    assert lake.read("bronze", "t").count() == 13
    # A batch may add rows and columns, a second stream its own rows; nothing may replace them.
    assert lake.append(spark.createDataFrame([("90", "y", "new")], "ID string, v string, more string"), "bronze", "t") == 1
    assert lake.append(spark.createDataFrame([("91", "z")], "id string, v string"), "bronze", "t") == 1
    append_stream(landed_files(spark, str(landing), ["id", "v"], 6).drop("_ingested_at"), lake, "bronze", "t", marks[1]).awaitTermination()
    got = lake.read("bronze", "t")
    assert got.count() == 28 and [r.more for r in got.filter("more is not null").collect()] == ["new"]
    with pytest.raises(ValueError, match="fed by a stream"):
        lake.overwrite(spark.range(1), "bronze", "t")
    with pytest.raises(ValueError, match="fed by a stream"):
        lake.append(spark.createDataFrame([(1.5,)], "_source_id double"), "bronze", "t")
    assert lake.read("bronze", "t").count() == 28


def test_encoding_is_judged_on_the_whole_input(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a;b\n" + "x;1\n" * 20_000 + "café;2\n", "latin-1")
    assert read_csv(spark, path).filter("b = 2").first().a == "café"
    path = write(tmp_path / "b.csv", "a;b\n" + "x;1\n" * 20_000 + "café;2\n")
    assert read_csv(spark, path).filter("b = 2").first().a == "café"


def test_display_numbers_keeps_text(spark):
    from terrace.operators.bi import display_numbers

    rows = display_numbers(spark.createDataFrame([("abc",), ("1.23456789",)], "v string"), ["v"]).collect()
    assert [tuple(r) for r in rows] == [("abc", None), ("1.23456789", 1.234568)]


@pytest.mark.parametrize("text", [
    '[{"a":1},{"a":2}] trailing [{"a":3}]', '[{"a":1}] [{"a":2}]', '{"a":1} {"a":2}', '{"a":1}}', '[{"a":1}]]', '[{"a":1}]} more', '{"a":1}, "b":2', '[{"a":1}],"size":10}', "[1, 2",
])
def test_text_behind_the_records_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="malformed JSON"):
        read_records(spark, str(tmp_path)).collect()


def test_whole_records_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"a":1,"size":"x"}, {"records":{"b":[1,{"c":null}]}, "a":"}]"}] \n')
    (tmp_path / "b.json").write_text('{"a":"é中"}\n')
    rows = {tuple(r) for r in read_records(spark, str(tmp_path)).select("a", "size", "records").collect()}
    assert rows == {("1", "x", None), ("}]", None, '{"b":[1,{"c":null}]}'), ("é中", None, None)}
    (tmp_path / "b.json").write_text("[]")
    assert read_records(spark, str(tmp_path)).count() == 2
