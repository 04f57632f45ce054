"""Scoring job: orders in, feature log and flags out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.operators.iforest import ForestModel, forest_scorer
from orderlens.operators.lof import LofModel, score_lof
from orderlens.operators.scaling import Scaler, apply_scaler
from orderlens.operators.scoring import flag_rows, norm_score, resolve_threshold
from orderlens.sources.tables import feature_log_rows, write_batch
from orderlens.streaming.state import live_features

STATE_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class ScoringConfig:
    """What a run scores with and where it writes."""

    scaler: Scaler
    model: LofModel | ForestModel | None
    output: str
    threshold: float | None = None
    manifest: dict | None = None

    def resolved(self) -> tuple[float | None, str]:
        return resolve_threshold(self.threshold, self.manifest)


def scorer(spark: SparkSession, config: ScoringConfig) -> Callable[[DataFrame], DataFrame]:
    """What scales and scores a table; prepared once a run. Without a model the score is the scaled length."""
    scale = lambda features: apply_scaler(features, config.scaler)
    if isinstance(config.model, LofModel):
        return lambda features: score_lof(config.model, scale(features))
    if isinstance(config.model, ForestModel):
        walk = forest_scorer(config.model, spark)
        return lambda features: walk(scale(features))
    return lambda features: norm_score(scale(features))


def flag_table(scored: DataFrame, now: datetime) -> DataFrame:
    """Flagged orders as stored: time, order, score, reason."""
    return scored.filter("flagged").select(
        F.lit(now).cast("timestamp").alias("timestamp"),
        F.col("order_id").cast("string").alias("order_id"),
        "order_item_id",
        F.col("score").alias("anomaly_score"),
        "reason",
    )


def run_state(spark: SparkSession, config: ScoringConfig, started: datetime, last: datetime, orders: int) -> DataFrame:
    """One row: threshold in force and where it came from, counts, times."""
    threshold, source = config.resolved()
    name = (config.manifest or {}).get("model_name", type(config.model).__name__)
    return spark.createDataFrame(
        [(name, threshold, source, started, last, orders)],
        "model_name string, threshold double, threshold_source string, started_at timestamp, "
        "last_processed_at timestamp, orders_processed bigint",
    )


def start_scoring(
    orders: DataFrame,
    seeds: tuple[DataFrame, DataFrame, DataFrame],
    config: ScoringConfig,
    checkpoint: str,
    available_now: bool = False,
):
    """Start the streaming query. Each micro-batch is logged, scored and flagged;
    all three outputs are keyed by batch id, so a retried batch replaces itself."""
    spark = orders.sparkSession
    spark.conf.set(STATE_STORE_SETTING, STATE_STORE)
    started = datetime.now(timezone.utc)
    threshold, _ = config.resolved()
    native = None if config.model is None else config.model.threshold
    if threshold is None and native is None:
        raise ValueError("no threshold: give one, a manifest, or a model")

    score = scorer(spark, config)

    def write(batch: DataFrame, batch_id: int) -> None:
        now = datetime.now(timezone.utc)
        # The log is written first and read back, so the state advances once.
        write_batch(batch, f"{config.output}/featured", batch_id)
        featured = batch.sparkSession.read.schema(batch.schema).parquet(
            f"{config.output}/featured/part={batch_id}"
        )
        write_batch(feature_log_rows(featured, now), f"{config.output}/features", batch_id, "json")
        scored = flag_rows(score(featured), threshold, native)
        write_batch(flag_table(scored, now), f"{config.output}/flags", batch_id)
        state = run_state(batch.sparkSession, config, started, now, featured.count())
        write_batch(state, f"{config.output}/runs", batch_id)

    writer = (
        live_features(orders, *seeds)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_record(spark: SparkSession, output: str) -> DataFrame:
    """One row a run: its threshold and where it came from, first start, last order, orders so far.

    Batches are stored by their id, so one that was tried again counts once.
    """
    batches = spark.read.parquet(f"{output}/runs")
    return batches.groupBy("model_name", "threshold", "threshold_source").agg(
        F.min("started_at").alias("started_at"),
        F.max("last_processed_at").alias("last_processed_at"),
        F.sum("orders_processed").alias("orders_processed"),
        F.count("*").alias("batches"),
    )
