"""Stages of the pipeline keep the columns of documents, whatever these are called."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = ("copies", "kept_text", "n_lines", "n_dropped", "rate")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    lines = corpus_pipeline.line_stage(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert lines.filter(F.col("kept_text") != F.concat(F.lit("kept_text"), F.col("doc_id").cast("string"))).count() == 0
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= docs.count()


def test_near_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_stage(spark, docs, SF)
    again = corpus_pipeline.near_stage(spark, kept, SF)
    assert kept.columns == docs.columns and again.count() == kept.count() < docs.count()


@pytest.mark.parametrize("bits", [23, 2])
def test_texts_that_no_decision_can_touch_are_not_joined(spark, monkeypatch, bits):
    from orderlens.llm import mixing, text

    monkeypatch.setattr(text, "FILTER_BITS", bits)
    rows = [(i if i % 50 else None, f"text {i}", "x") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    gone = docs.filter("doc_id % 10 = 3").select("doc_id")
    stay, asked = text.apart(docs, "doc_id", gone, "doc_id")
    assert stay.columns == asked.columns == docs.columns
    assert stay.unionByName(asked).exceptAll(docs).count() == 0 and stay.count() + asked.count() == 1000
    assert stay.filter("doc_id % 10 = 3").count() == 0
    if bits == 23:
        assert asked.count() < 110
    copies = F.when(F.col("doc_id").isNull(), 2).when(F.col("doc_id") % 10 == 3, 0).otherwise(1)
    mixed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), copies.cast("long").alias("copies"))
    got = mixing.apply_mix(docs, mixed)
    want = docs.filter("doc_id is null").unionByName(docs.filter("doc_id is null or doc_id % 10 != 3"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_texts_are_not_shuffled_for_a_filter_above_the_broadcast_threshold(spark):
    from orderlens.llm import text

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = docs.filter("doc_id % 10 = 3").select("doc_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16")
    try:
        stay, asked = text.apart(docs, "doc_id", gone, "doc_id")
        for part in (stay, asked):
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
