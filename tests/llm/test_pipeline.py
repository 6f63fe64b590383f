"""The pipeline: its stages in order, on a small table, and what each must do."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] > 0.6 * sizes[0]
    texts = [r.text for r in docs.select("text").collect()]
    assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_near_duplicates_are_dropped_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(0)), (1, text(1)), (2, text(0) + " more"), (None, text(2)), (None, text(2)), (None, text(3)), (3, text(4)), (3, text(4)), (4, ""), (4, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    starts = sorted(r.text.split(" ")[0] for r in left)
    assert starts == ["", "", "w0x0", "w1x0", "w2x0", "w3x0", "w4x0"]
    assert (1, text(1)) in [tuple(r) for r in left] and sorted(r.doc_id for r in left if not r.text) == [4, 5]


def test_stages_keep_columns_of_any_name(spark):
    names = ["kept", "score", "predicted", "base", "spans", "row", "key", "_row", "n_words", "hex", "p_good"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("*", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    docs = staged(docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.schema.names == docs.schema.names, name
        rows = left.collect()
        assert rows and all(r[n] == before[r.doc_id][n] for r in rows for n in names), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
