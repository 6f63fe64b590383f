from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions import names
from terrace.functions.dates import parse_date, parse_with_format, spark_format
from terrace.functions.numbers import parse_number
from terrace.functions.text import strip, template, to_sql_expression


def values(spark, texts, expression):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.StringType())])
    df = spark.createDataFrame(list(enumerate(texts)), schema)
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "Rp 1.500.000,00": 1500000.0, "Rp 250.000": 250000.0, "(50.000,00)": -50000.0,
        "100 pcs": 100.0, "15.5%": 15.5, "12,5": 125.0, "1.0d": None, "1.5f": None,
        "-1.234.567": -1234567.0, "abc": None, None: None, "": None, "1,234.56": 1234.56,
        "usd 5": 5.0, "5 USD": 5.0, "(5": None, "5)": None, "(abc)": None, "1.": 1.0, ".5": 0.5,
        "+5": 5.0, "1e5": 100000.0, "1_000": None, "-": None, "  8\t": 8.0, "30 °C": 30.0,
        "1.500": 1500.0, "-5 kg.": -5.0, "1.2,3,4": None, "1,2,3": 123.0, "Rp. 5": None,
        "0x10": None, "inf": float("inf"), "nan": None, "--5": None, "(USD 1.000)": -1000.0,
        "12.34.56": None, "1234.567": 1234.567, "5 kg USD": 5.0,
    }
    assert values(spark, list(cases), parse_number) == list(cases.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 99)), min_size=1, max_size=30))
def test_number_styles_agree(spark, amounts):
    texts, wanted = [], []
    for whole, cents in amounts:
        english = f"{whole:,}.{cents:02d}"
        local = english.translate(str.maketrans(",.", ".,"))
        texts += [f"Rp {local}" if whole > 999 else f"Rp {english}", f"({english})", f" {english} kg"]
        exact = float(f"{whole}.{cents:02d}")
        wanted += [exact, -exact, exact]
    assert values(spark, texts, parse_number) == wanted


def test_dates(spark):
    d = datetime
    cases = {
        "2024/01/05": d(2024, 1, 5), "2024-1-5": d(2024, 1, 5), "01-02-2024": d(2024, 2, 1),
        "13/01/2024": d(2024, 1, 13), "01/13/2024": d(2024, 1, 13), "5 Jan 2024": d(2024, 1, 5),
        "Jan 5, 2024": d(2024, 1, 5), "5-Jan-24": d(2024, 1, 5), "20240105": d(2024, 1, 5),
        "2024-01-05T10:11:12Z": d(2024, 1, 5, 10, 11, 12),
        "2024-01-05 10:11:12+07:00": d(2024, 1, 5, 3, 11, 12),
        "01/02/24": d(2024, 2, 1), "31/12/99": d(1999, 12, 31), "24-01-05": d(2005, 1, 24),
        "2024": d(2024, 1, 1), "Jan 2024": d(2024, 1, 1), "12/2024": d(2024, 12, 1),
        "5 January 2024 10:30 PM": d(2024, 1, 5, 22, 30), "1/2/2024 12:05 am": d(2024, 2, 1, 0, 5),
        "2024-02-30": None, "31/04/2024": None, "10:30": None, "Mon, 5 Jan 2024": d(2024, 1, 5),
        "05/01/2024 13:45": d(2024, 1, 5, 13, 45), "abc": None, "": None, None: None,
        "2024-01-05 10:11:12.123456": d(2024, 1, 5, 10, 11, 12, 123456), "1-URGENT": None,
    }
    assert values(spark, list(cases), parse_date) == list(cases.values())
    assert values(spark, ["01/02/2024"], lambda c: parse_date(c, False)) == [d(2024, 1, 2)]


def test_date_formats(spark):
    assert spark_format("YYYY-MM-DD") == "yyyy-MM-dd"
    assert spark_format("dd/mm/yyyy") == "dd/MM/yyyy"
    assert spark_format("DD/MM/YYYY HH:mm:ss") == "dd/MM/yyyy HH:mm:ss"
    assert spark_format("") is None and spark_format(None) is None
    got = values(spark, ["5/1/2024", "2024-01-05", None], lambda c: parse_with_format(c, "DD/MM/YYYY"))
    assert got == [datetime(2024, 1, 5), None, None]


def test_text(spark):
    assert values(spark, ["\t a ", " b\n", "  "], strip) == ["a", "b", ""]
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(template("R_{a}_{b}_{c}{", df.columns)).first()[0] == "R_x_None_{c}{"
    assert to_sql_expression("a == 'x & y' & b | ~c") == "a == 'x & y'  AND  b  OR   NOT c"
    assert to_sql_expression("a || 'b'") == "a || 'b'"
    assert "in ('A')" in to_sql_expression("s in ['A']")


def test_names():
    assert names.safe_identifier("Table Name!") == "Table_Name_"
    assert names.safe_identifier("drop table;--") == "drop_table_--"
    assert names.safe_identifier("123column") == "123column"
    assert [names.check_layer(n) for n in ("bronze", " SILVER", "GOLD")] == ["bronze", "silver", "gold"]
    for bad in (lambda: names.check_layer("x"), lambda: names.safe_identifier(""),
                lambda: names.strict_identifier("1a"), lambda: names.strict_identifier("a b")):
        with pytest.raises(ValueError):
            bad()
    assert names.strict_identifier(" a-b_1 ") == "a-b_1"
    columns = ["Debit (IDR)", "Sales_Rep", "id"]
    assert names.resolve_column(columns, "Debit") == "Debit (IDR)"
    assert names.resolve_column(columns, "sales rep") == "Sales_Rep"
    assert names.resolve_column(columns, "nothing") is None
    assert names.resolve_column(columns, "") is None
    assert names.record_column("2nd Key!") == "col_2nd_key" and names.record_column("!!") == "col"
    assert names.pii_kind("E-mail") == "EMAIL" and names.pii_kind("No_HP") == "PHONE"
    assert names.pii_kind("nik_ktp") == "NIK" and names.pii_kind("rekening") == "CARD"
    assert names.pii_kind("amount") is None
    assert names.column_role("status_code", T.LongType()) == "categorical"
    assert names.column_role("amount", T.LongType()) == "numeric"
    assert names.column_role("day", T.DateType()) == "date"
    assert names.unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
