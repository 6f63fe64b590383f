"""Incremental ingest of newly landed files, and incremental upserts, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace import constants as K
from terrace.operators.join import latest_per_key
from terrace.sources.files import delimited
from terrace.sources.lake import Lake


def landed_files(
    spark: SparkSession, path: str, columns: list[str], source_id: int, **options
) -> DataFrame:
    """A stream of the rows of new delimited files, all text, with the bronze columns.

    Bad rows are treated as by ``read_csv``. ``sep`` and ``encoding`` are taken from the options.
    """
    separator, encoding = options.pop("sep", ","), options.pop("encoding", "UTF-8")
    rows = delimited(spark.readStream.options(**options), path, columns, separator, encoding)
    return rows.withColumns({
        K.INGESTED_AT: F.current_timestamp(), K.SOURCE_ID: F.lit(int(source_id)),
    })


def append_stream(
    stream: DataFrame, lake: Lake, layer: str, table: str, checkpoint: str
) -> StreamingQuery:
    """Append what has landed since the last run to a table, then stop.

    The log of the file sink makes a batch that runs again count once.
    """
    return lake.land(stream, layer, table, checkpoint).trigger(availableNow=True).start()


def upsert_stream(
    stream: DataFrame, lake: Lake, layer: str, table: str, keys: list[str], checkpoint: str,
    order: list[str] | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into a table by key, then stop.

    Running a batch again after a failure gives the same table. With ``order`` the newest row of a
    key wins inside a batch; without it a repeated key is an error.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = latest_per_key(batch, keys, order) if order else batch
        lake.upsert(rows, layer, table, keys)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
