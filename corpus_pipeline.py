"""The documents table through five stages, from quality to token ids.

Every stage takes what its predecessor kept and returns the columns of documents;
the last adds the ids. ``run`` writes each stage to the shared folder and reads it
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import bpe, linededup, mixing, nearhash, quality
from orderlens.session import materialise

#: Shares of the tokens that come in; None is the share that is there. Clean documents stay whole, others are thinned out.
WEIGHTS = {"good": None, "toxic": 0.02, "poor": 0.01}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, _labels(spark, sf_dir), F.col("source"), quality.source_path())


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every shared line stays in the smallest doc_id holding it; n_chars counts what is left."""
    # Other columns travel in one, so that none can clash with what the operator adds.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("__others"))
    cleaned = linededup.dedup_lines(packed)
    new = {c: F.col("__others").getField(c) for c in others}
    new |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cleaned.select(*[new[c].alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8 or more."""
    return nearhash.drop_near_duplicates(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by rates of at most 1, fitted to the target weights."""
    mixed = mixing.mix_documents(docs, _labels(spark, sf_dir), WEIGHTS, max_rate=1.0)
    return mixing.apply_mix(docs, mixed)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, and digests of the ids and of what they decode to."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks), ranks)
    return bpe.with_digests(coded).select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near-duplicates", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Neither the fitted classifiers nor the byte-level merges are SQL. The operators are tested one by one in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
