"""Landed files: delimited text and JSON records, read as text without inference."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.names import col, record_column, unique_names

#: The separator is judged by this many characters.
SAMPLE_CHARACTERS = 8192
_BAD = "__bad_line"


def _head(spark: SparkSession, path: str) -> list[str]:
    lines, size = [], 0
    text = spark.read.text(path).select(F.substring("value", 1, SAMPLE_CHARACTERS).alias("value"))
    for row in text.limit(SAMPLE_CHARACTERS).collect():
        lines.append(row.value)
        size += len(row.value) + 1
        if size >= SAMPLE_CHARACTERS:
            break
    return lines


def detect_separator(lines: list[str]) -> str:
    try:
        return csv.Sniffer().sniff("\n".join(lines)[:SAMPLE_CHARACTERS], ",;\t|").delimiter
    except csv.Error:
        return ","


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the input is valid in it, else Latin-1, which every byte is valid in."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_csv(
    spark: SparkSession, path: str, multiline: bool = False, encoding: str | None = None
) -> DataFrame:
    """A delimited file with a header, every column text.

    Rows with too many fields are left out, short rows are padded with nulls. Files stay
    splittable unless ``multiline`` asks for quoted line breaks. Naming the ``encoding`` saves the
    pass over the input that finds it.
    """
    lines = _head(spark, path)
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    separator = detect_separator(lines)
    encoding = encoding or detect_encoding(spark, path)
    if encoding.upper() != "UTF-8":
        header = spark.read.option("encoding", encoding).option("sep", "\x01").csv(path).first()[0]
    else:
        header = spark.read.text(path).first().value.removeprefix("﻿")
    names = unique_names([
        n or f"Unnamed: {i}" for i, n in enumerate(next(csv.reader([header], delimiter=separator)))
    ])
    return delimited(spark.read, path, names, separator, encoding, multiline)


def delimited(
    reader, path: str, names: list[str], separator: str = ",", encoding: str = "UTF-8",
    multiline: bool = False,
) -> DataFrame:
    """The rows of delimited files under one bad-row rule, for batch and stream readers."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
    rows = (
        reader.schema(schema)
        .option("header", True)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .option("columnPruning", False)  # field counts are only known for whole rows
        .option("multiLine", multiline)
        .csv(path)
    )
    bare = F.regexp_replace(F.col(_BAD), r'(?s)"[^"]*"', "")
    # The empty piece refers to a data column: Spark refuses plans that read only the bad lines.
    bare = F.concat_ws("", bare, F.substring(col(names[0]), 1, 0))
    fields = F.size(F.split(bare, re.escape(separator)))
    return rows.filter(F.col(_BAD).isNull() | (fields <= len(names))).select(*map(col, names))


def landed_format(spark: SparkSession, path: str) -> str:
    """``json`` where the text starts with a brace or a bracket, else ``csv``."""
    text = "".join(_head(spark, path)).lstrip()
    return "json" if text[:1] in ("{", "[") else "csv"


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records as text columns, one per key, in the order keys first appear.

    Each file holds one array or one object, or with ``lines`` one object per line. Nested values
    stay JSON text. A text that is no such JSON is an error, so that no record is lost unseen.
    """
    if lines:
        texts = spark.read.text(path)
    else:
        texts = spark.read.text(path, wholetext=True)
    texts = texts.select(F.btrim("value", F.lit(" \t\n\r\ufeff")).alias("value")).filter("value != ''")
    # Read as the first of two members of an object, the text's length being the other: anything behind the array or object breaks that.
    size = F.char_length("value")
    whole = F.concat(F.lit('{"records":'), "value", F.lit(',"size":'), size.cast("string"), F.lit("}"))

    two = F.json_object_keys(whole) == F.array(F.lit("records"), F.lit("size"))

    def read(kind: str) -> Column:
        parsed = F.from_json(whole, f"records {kind}, size int")
        return F.when(two & (parsed["size"] == size), parsed["records"])

    one, many = read("map<string,string>"), read("array<map<string,string>>")
    found = F.when(F.col("value").startswith("["), many).otherwise(
        F.when(one.isNotNull(), F.array(one)))
    broken = F.raise_error(F.concat(F.lit("malformed JSON: "), F.substring("value", 1, 80)))
    records = texts.select(
        F.posexplode(F.coalesce(found, broken.cast("array<map<string,string>>")))
        .alias("place", "record")
    )
    keys = (
        records.select("place", F.posexplode(F.map_keys("record")).alias("at", "key"))
        .groupBy("key")
        .agg(F.min(F.struct("place", "at")).alias("first"))
        .orderBy("first", "key")
        .collect()
    )
    names = [r.key for r in keys]
    return records.select(*[F.col("record")[n].alias(n) for n in names])


def record_columns(df: DataFrame) -> DataFrame:
    """Column names made from record keys: lower case, plain characters, no leading digit."""
    return df.toDF(*unique_names([record_column(n) for n in df.columns]))
