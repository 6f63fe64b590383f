"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm import minhash_dedup, packing, quality_rules, secret_scan, toxicity
from terrace.llm.bitmap import Bitmap
from terrace.llm.common import freeing, reachable, staged


def _packed(docs: DataFrame) -> DataFrame:
    """The texts, and each whole row in one column, so that no column of the documents meets one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a toxicity score under 0.5. Null and empty texts are scored as the classifier scores no words.

    Repeated rows are alike, an empty table gives an empty one, further columns may have any name and come along.
    """
    reachable(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_packed(docs), model).filter("predicted = 0").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality rules accept. Rows without words go, so null and empty texts do.

    Repeated rows are alike, an empty table gives an empty one, further columns may have any name and come along.
    """
    reachable(spark)
    # Staged with the texts: a filter on the verdict would otherwise be planned as one expression over all the counts.
    counts = staged(quality_rules.with_counts(_packed(docs)).drop("text"))
    return quality_rules.judged(counts, quality_rules.fit(counts)).filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, by shingles of five words: the one with the least id. Different texts under
    one id, or under none, are different rows; repeated rows are copies, also where their texts have no words.
    """
    reachable(spark)
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2")).alias("key"),
        F.col("text").alias("text"))
    with freeing(spark) as keep:
        judged = minhash_dedup.near_duplicates(keyed, doc_id="key").groupBy("key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("copies"))
        marked = keep(staged(judged.filter("not kept or copies > 1")))
    return _without(keyed, marked, Bitmap.of(marked.select("key.h")))


def _without(keyed: DataFrame, marked: DataFrame, seen: Bitmap) -> DataFrame:
    """Rows without those whose key is marked as not kept, and one of each marked as repeated. Rows outside of the bitmap are not shuffled."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("maybe", pa.array(seen.holds(batch.column(2).to_numpy().view(np.uint64))))

    rows = keyed.select("row", "key", F.col("key.h").alias("h"))
    schema = T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())])
    flags = rows.mapInArrow(flagged, schema)
    rest = flags.filter("maybe").join(marked, "key", "left").filter("coalesce(kept, true)")
    kept = rest.filter("coalesce(copies, 1) = 1").unionByName(rest.filter("copies > 1").dropDuplicates(["key"])).select("row.*")
    return flags.filter("not maybe").select("row.*").unionAll(kept)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by its kind; ``n_chars`` follows the new text. Null texts become empty ones.

    Repeated rows are alike, an empty table gives an empty one, further columns may have any name and come along.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    clean = secret_scan.scan(docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), "text"), redact=True)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return clean.select(*(new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    reachable(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: Neither the trained stages nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again, and what led to it is freed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with freeing(spark) as last:
        for _, stage in STAGES[:-1]:
            with freeing(spark) as keep:
                docs = keep(staged(stage(spark, docs, sf_dir)))
        last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
