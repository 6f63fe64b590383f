"""Lakehouse tables: parquet snapshots under ``<root>/<layer>/<table>``.

An overwrite makes a new snapshot folder. Readers take the newest folder in which Spark has left its
``_SUCCESS`` file, so a table changes at once or not at all, nothing is overwritten while being read, and
a lost executor or driver leaves the old snapshot in place. An append is Spark's own append to the newest
snapshot. Streams land in a folder of their own beside the snapshots, written by Spark's file sink, whose
log makes every batch count once; a table is its newest snapshot and all that streams have landed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from terrace import constants as K
from terrace.functions.dates import parse_date
from terrace.functions.names import (
    as_list, check_layer, col, has_word, is_number, is_text, is_time, logical_type,
    safe_identifier,
)
from terrace.functions.numbers import as_number
from terrace.operators.join import align_columns, append_rows, repeated_keys, upsert_rows

_SCHEMA = "_schema.json"


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- folders -----------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _glob(self, pattern: str) -> list:
        fs, target = self._fs(pattern)
        return [s.getPath() for s in (fs.globStatus(target) or [])]

    def folder(self, layer: str, table: str) -> str:
        return f"{self.root}/{check_layer(layer)}/{safe_identifier(table).lower()}"

    def snapshots(self, layer: str, table: str) -> list[str]:
        """Finished snapshots, oldest first."""
        done = self._glob(f"{self.folder(layer, table)}/v=*/_SUCCESS")
        return sorted(p.getParent().toString() for p in done)

    def exists(self, layer: str, table: str) -> bool:
        return bool(self.snapshots(layer, table) or self.landings(layer, table))

    def landings(self, layer: str, table: str) -> list[str]:
        """Folders that streams have landed rows in."""
        logs = self._glob(f"{self.folder(layer, table)}/stream-*/_spark_metadata")
        return sorted(p.getParent().toString() for p in logs)

    def tables(self) -> list[tuple[str, str]]:
        marks = [
            *self._glob(f"{self.root}/*/*/v=*/_SUCCESS"),
            *self._glob(f"{self.root}/*/*/stream-*/_spark_metadata"),
        ]
        found = {
            (p.getParent().getParent().getParent().getName(), p.getParent().getParent().getName())
            for p in marks
        }
        return sorted(t for t in found if t[0] in K.LAYERS)

    def _new_snapshot(self, layer: str, table: str) -> str:
        return f"{self.folder(layer, table)}/v={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _save_schema(self, folder: str, schema: T.StructType) -> None:
        fs, target = self._fs(f"{folder}/{_SCHEMA}")
        out = fs.create(target, True)
        out.write(bytearray(schema.json(), "utf-8"))
        out.close()

    def _load_schema(self, folder: str) -> T.StructType:
        fs, target = self._fs(f"{folder}/{_SCHEMA}")
        stream = fs.open(target)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return T.StructType.fromJson(json.loads(text))

    def _drop(self, folder: str) -> None:
        fs, target = self._fs(folder)
        fs.delete(target, True)

    # --- reading -----------------------------------------------------------------------------

    def read(self, layer: str, table: str) -> DataFrame:
        """The newest snapshot and what streams have landed. Stored schemas save reading file footers."""
        folders = [*self.snapshots(layer, table)[-1:], *self.landings(layer, table)]
        if not folders:
            raise ValueError(f"table {layer}.{table} not found")
        parts = [self.spark.read.schema(self._load_schema(f)).parquet(f) for f in folders]
        return reduce(append_rows, parts)

    def find(self, name: str) -> DataFrame:
        """A table by ``layer.table``, or by name in the first layer that has it."""
        layer, dot, table = name.partition(".")
        if dot and layer.lower() in K.LAYERS:
            return self.read(layer, table)
        for layer in ("silver", "gold", "bronze"):
            if self.exists(layer, name):
                return self.read(layer, name)
        raise ValueError(f"table {name} not found")

    # --- writing -----------------------------------------------------------------------------

    def overwrite(self, df: DataFrame, layer: str, table: str) -> int:
        """Write a new snapshot and keep the three before it. A table that a stream feeds only grows."""
        if self.landings(layer, table):
            raise ValueError(f"table {layer}.{table} is fed by a stream: rows can only be added")
        snapshot = self._new_snapshot(layer, table)
        old = self.snapshots(layer, table)
        self._begin(df, snapshot)
        for path in old[: -K.BACKUPS_KEPT]:
            self._drop(path)
        return self.count(layer, table)

    def _begin(self, df: DataFrame, snapshot: str) -> None:
        """Write a snapshot. The schema is there before ``_SUCCESS`` makes it visible."""
        try:
            self._save_schema(snapshot, _nullable(df.schema))
            df.write.mode("append").parquet(snapshot)
        except Exception:
            self._drop(snapshot)
            raise

    def append(self, df: DataFrame, layer: str, table: str) -> int:
        """Add rows to the newest snapshot. Returns how many.

        New columns are added. Where the types of a column differ, the wider one counts; if that is not
        the table's, the table is written anew. A value that has no form in that type ends the write
        with an error, and the table stays as it was.
        """
        old = self.snapshots(layer, table)
        if not self.exists(layer, table):
            return self.overwrite(df, layer, table)
        current = self.read(layer, table)
        df, schema, fits = _fitted(current, df)
        if not fits:
            rows = current.count()
            return self.overwrite(append_rows(_cast_to(current, schema), df), layer, table) - rows
        if not old:  # so far there are rows of streams only
            snapshot, before = self._new_snapshot(layer, table), set()
            self._begin(df, snapshot)
        else:
            snapshot, before = old[-1], set(self.spark.read.schema(schema).parquet(old[-1]).inputFiles())
            df.write.mode("append").parquet(snapshot)
            if len(schema) > len(current.columns):
                self._save_schema(snapshot, schema)
        added = [f for f in self.spark.read.schema(schema).parquet(snapshot).inputFiles() if f not in before]
        return self.spark.read.schema(schema).parquet(*added).count() if added else 0

    def land(self, stream: DataFrame, layer: str, table: str, checkpoint: str) -> DataStreamWriter:
        """A writer that lands a stream's rows in the table, each batch once, as Spark's file sink does.

        Columns get the table's types; new ones are added. A stream whose types are wider than the table's is refused.
        A checkpoint stands for one stream, which has one folder for good.
        """
        folder = f"{self.folder(layer, table)}/stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
        if self.exists(layer, table):
            stream, schema, fits = _fitted(self.read(layer, table), stream)
            if not fits:
                raise ValueError(f"the stream's types are wider than those of {layer}.{table}: {schema.simpleString()}")
        self._save_schema(folder, _nullable(stream.schema))
        return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)

    def upsert(self, df: DataFrame, layer: str, table: str, keys: list[str]) -> int:
        """Merge rows by key into a new snapshot. Keys must be unique and present in the batch."""
        wanted = {k.lower() for k in keys}
        usable = [n for n in df.columns if n.lower() in wanted]
        if usable:
            clash = repeated_keys(df, usable).limit(1).collect()
            if clash:
                raise ValueError(f"repeated or missing key in the batch: {clash[0].asDict()}")
        if not self.exists(layer, table):
            return self.overwrite(df, layer, table)
        if not usable:
            return self.append(df, layer, table)
        current = self.read(layer, table)
        df = align_columns(current, df)
        schema = _common_schema(current.schema, df.schema)
        merged = upsert_rows(_cast_to(current, schema), _cast_to(df, schema), usable)
        return self.overwrite(merged, layer, table)

    def write(
        self, df: DataFrame, layer: str, table: str, mode: str = "overwrite", keys=None,
        context: dict | None = None, as_of: datetime | None = None,
    ) -> int:
        """Stamp, harden and write a frame. Returns the number of rows the frame has."""
        out = harden_types(stamp(df, context, as_of))
        out = out.toDF(*[safe_identifier(n) for n in out.columns])
        mode = mode.lower().strip()
        if mode == "overwrite":
            return self.overwrite(out, layer, table)
        if mode == "append":
            return self.append(out, layer, table)
        if mode == "upsert":
            return self.upsert(out, layer, table, as_list(keys))
        raise ValueError(f"unknown write mode {mode!r}")

    def count(self, layer: str, table: str) -> int:
        """Rows of a table, from file footers."""
        return self.read(layer, table).count()

    # --- bronze ------------------------------------------------------------------------------

    def ingest(self, df: DataFrame, source_id: int, as_of: datetime | None = None):
        """Land a source as text in ``bronze.csv_<id>``; returns (table, rows, columns)."""
        if not df.columns or df.isEmpty():
            return "", 0, []
        table = f"csv_{int(source_id)}"
        columns = [{"name": n, "type": "TEXT"} for n in df.columns]
        landed = as_text(df).withColumns({
            K.INGESTED_AT: now(as_of), K.SOURCE_ID: F.lit(int(source_id)),
        })
        return table, self.overwrite(landed, "bronze", table), columns

    def ingest_records(self, df: DataFrame, source_id: int, as_of: datetime | None = None):
        """Land fetched records in a new table ``bronze.api_<id>_<time>``."""
        moment = as_of or datetime.now(UTC)
        table = f"api_{int(source_id)}_{moment:%Y%m%d%H%M%S}"
        if not df.columns:
            return table, 0
        landed = as_text(df).withColumn(K.FETCHED_AT, now(moment))
        return table, self.overwrite(landed, "bronze", table)

    def ingest_extract(self, df: DataFrame, source_id: int):
        """Land a database extract as text in ``bronze.ext_db_<id>``, replacing the last one."""
        table = f"ext_db_{source_id}".lower().replace("-", "_")
        return table, self.overwrite(as_text(df), "bronze", table)

    # --- metadata ----------------------------------------------------------------------------

    def discover(self) -> DataFrame:
        """One row per table: name, columns, and rows. The lake's own tables are left out."""
        own = [(layer, t) for layer, t in self.tables() if not t.startswith("_")]
        return describe_tables(
            self.spark, {f"{layer}.{t}": self.read(layer, t) for layer, t in own}
        )

    def register(self, outputs: list[dict], as_of: datetime | None = None) -> None:
        """Keep one catalog row per written table."""
        if not outputs:
            return
        latest = {(o["layer"], o["table"]): o for o in outputs}.values()
        rows = [
            (o["layer"].upper(), o["table"], o["table"].replace("_", " ").title(),
             json.dumps(o["columns"]), o["rows"])
            for o in latest
        ]
        schema = "layer string, tableName string, displayName string, schema string, rowsCount long"
        entries = self.spark.createDataFrame(rows, schema).withColumn("updatedAt", now(as_of))
        self.upsert(entries, "gold", "_catalog", ["layer", "tableName"])

    def catalog(self) -> DataFrame:
        return self.read("gold", "_catalog")


def now(as_of: datetime | None) -> Column:
    return F.lit(as_of or datetime.now(UTC)).cast("timestamp")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[
        col(f.name).cast("string").alias(safe_identifier(f.name)) for f in df.schema
    ])


def stamp(df: DataFrame, context: dict | None = None, as_of: datetime | None = None) -> DataFrame:
    """Add the lineage columns."""
    marks = {K.ETL_TIMESTAMP: now(as_of)}
    if context is not None:
        marks[K.RUN_ID] = F.lit(int(context.get("run_id", 0))).cast("bigint")
        marks[K.PIPELINE_ID] = F.lit(int(context.get("pipeline_id", 0))).cast("bigint")
    return df.withColumns(marks)


def harden_types(df: DataFrame) -> DataFrame:
    """Money and date columns, known by name, get numbers and timestamps whatever they hold now."""
    hard = {}
    for f in df.schema:
        if is_number(f.dataType) or is_time(f.dataType):
            continue
        if has_word(f.name, K.MONEY_WORDS):
            hard[f.name] = as_number(df, f.name).cast("double")
        elif has_word(f.name, K.DATE_WORDS) and is_text(f.dataType):
            hard[f.name] = parse_date(col(f.name))
    return df.withColumns(hard) if hard else df


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_count, columns_json, row_count`` of each frame; counts run as one job."""
    counts = None
    for name, df in tables.items():
        columns = [{"name": f.name, "type": logical_type(f.dataType)} for f in df.schema]
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(columns)).cast("bigint").alias("column_count"),
            F.lit(json.dumps(columns)).alias("columns_json"),
            "row_count",
        )
        counts = one if counts is None else counts.unionAll(one)
    schema = "table_name string, column_count long, columns_json string, row_count long"
    return spark.createDataFrame([], schema) if counts is None else counts


def table_schema(df: DataFrame) -> DataFrame:
    """Column names and type labels as rows."""
    rows = [(i, f.name, logical_type(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def source_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows_count")).withColumn(
        "columns_count", F.lit(len(df.columns)).cast("bigint")
    )


def preview(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first rows of the asked columns, and the exact number of rows."""
    shown = df.select(*map(col, columns)) if columns else df
    return shown.limit(K.PREVIEW_ROWS), df.agg(F.count(F.lit(1)).alias("total"))


def _fitted(current: DataFrame, df: DataFrame) -> tuple[DataFrame, T.StructType, bool]:
    """A batch with the names and types of a table, the schema of both, and whether the table's part of it is as before."""
    df = align_columns(current, df)
    schema = _common_schema(current.schema, df.schema)
    return _cast_to(df, schema), schema, schema.fields[: len(current.columns)] == _nullable(current.schema).fields


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _common_schema(table: T.StructType, batch: T.StructType) -> T.StructType:
    """The table's columns in types that hold both sides, then the columns only the batch has."""
    incoming = {f.name: f.dataType for f in batch}
    fields = [(f.name, _wider(f.dataType, incoming.get(f.name, f.dataType))) for f in table]
    known = set(table.names)
    fields += [(f.name, f.dataType) for f in batch if f.name not in known]
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _wider(table: T.DataType, batch: T.DataType) -> T.DataType:
    """Numbers widen from integers over decimals to doubles, dates to timestamps; else the table's type."""
    if table == batch or not (is_number(table) and is_number(batch)):
        dates = isinstance(table, T.DateType) and isinstance(batch, (T.TimestampType, T.TimestampNTZType))
        return batch if dates else table
    if isinstance(table, T.FractionalType) and isinstance(batch, T.FractionalType) or T.DecimalType in (
        type(table), type(batch)
    ):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (table, batch)):
            return T.DoubleType()
        whole = max(_DIGITS.get(type(t)) or t.precision - t.scale for t in (table, batch))
        scale = max(getattr(t, "scale", 0) for t in (table, batch))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (table, batch)):
        return T.DoubleType()
    return max(table, batch, key=lambda t: _DIGITS[type(t)])


#: Digits that hold every value of an integer type.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame's columns in the types of a schema. A value that would be lost is an error of its task."""
    types = {f.name: f.dataType for f in schema}

    def cast(f: T.StructField) -> Column:
        value, wanted = col(f.name), types[f.name]
        if wanted == f.dataType:
            return value
        new = value.try_cast(wanted)
        lost = new.isNull()
        if isinstance(f.dataType, T.LongType) and isinstance(wanted, T.DoubleType):
            lost = lost | ~(new.try_cast("bigint").eqNullSafe(value))
        message = F.concat(
            F.lit(f"column {f.name}: not of type {wanted.simpleString()}: "), value.cast("string")
        )
        failed = F.raise_error(message).cast(wanted)
        return F.when(value.isNotNull() & lost, failed).otherwise(new).alias(f.name)

    return df.select(*map(cast, df.schema))
