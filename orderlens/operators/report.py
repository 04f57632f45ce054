"""Reporting queries over the flags table, the feature log and metrics tables.

A flag row has ``timestamp``, ``order_id``, ``anomaly_score``, ``reason``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions.exprs import half_up, ratio
from orderlens.operators.features import FEATURES

# Bands, labels and sizes of the published report.
EXPECTED_RATE = 0.065
LIVE_SECONDS = 60
REASON_TYPES = {
    "price_deviation_from_supplier_category_avg": "price",
    "delivery_delay_deviation": "delivery",
    "discount_rate_anomaly": "discount",
    "stock_after_order": "stock",
    "days_of_cover_remaining": "inventory",
}
KNOWN_TYPES = ["price", "delivery", "inventory", "discount", "stock"]
METRIC_DEFAULTS = {
    "precision": 0.289,
    "recall": 0.366,
    "f1": 0.323,
    "price_spike": 0.257,
    "delivery_delay": 0.999,
    "inventory_depletion": 0.156,
    "threshold": 4.5368,
}


def severity(score: Column) -> Column:
    return F.when(score >= 10, "High").when(score >= 6, "Medium").otherwise("Low")


def primary_signal(reason: Column) -> Column:
    """Feature named first in a reason text; empty when there is none."""
    first = F.trim(F.split_part(F.coalesce(reason, F.lit("")), F.lit(";"), F.lit(1)))
    return F.regexp_extract(first, "^([a-z_]+)", 1)


def reason_type(signal: Column) -> Column:
    kind = F.lit("other")
    for feature in FEATURES:
        kind = F.when(signal == feature, REASON_TYPES[feature]).otherwise(kind)
    return kind


def with_reason_type(flags: DataFrame) -> DataFrame:
    return flags.withColumn("signal", primary_signal(F.col("reason"))).withColumn(
        "type", reason_type(F.col("signal"))
    )


def display_rows(flags: DataFrame) -> DataFrame:
    """Rows as the report shows them."""
    return with_reason_type(flags).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("order_id").cast("string").alias("order_id"),
        F.col("anomaly_score").alias("score"),
        severity(F.col("anomaly_score")).alias("severity"),
        "type",
        "signal",
        F.substring("reason", 1, 110).alias("reason"),
    )


def of_types(rows: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Rows of the chosen reason types; nothing chosen means all known types."""
    return rows.filter(F.col("type").isin(chosen or KNOWN_TYPES))


def newest(flags: DataFrame, n: int | None = None, order: list[str] = ("timestamp", "order_id")) -> DataFrame:
    """Flags newest first; the last ``n`` of them, or all."""
    ordered = flags.orderBy(*[F.desc(c) for c in order])
    return ordered if n is None else ordered.limit(n)


def flags_after(flags: DataFrame, last_id: int, id_col: str = "batch_id") -> DataFrame:
    """Flags written since ``last_id``; all of them if the table was started anew."""
    top = flags.agg(F.max(id_col)).first()[0]
    if top is not None and top < last_id:
        return flags
    return flags.filter(F.col(id_col) > last_id)


def volume_unit(first: datetime, last: datetime, rows: int) -> str:
    """Bucket size for a time span; a burst inside one bucket is cut finer."""
    seconds = (last - first).total_seconds()
    if seconds <= 60:
        unit, shape = "second", "%Y%m%d%H%M%S"
    elif seconds <= 2 * 3600:
        unit, shape = "minute", "%Y%m%d%H%M"
    elif seconds <= 7 * 86400:
        unit, shape = "hour", "%Y%m%d%H"
    else:
        unit, shape = "day", "%Y%m%d"
    one = first.strftime(shape) == last.strftime(shape)
    return "centisecond" if one and rows > 1 else unit


# Label format of each bucket size.
LABELS = {
    "centisecond": "HH:mm:ss.SS",
    "second": "HH:mm:ss",
    "minute": "HH:mm",
    "hour": "MM-dd HH:00",
    "day": "yyyy-MM-dd",
}


def time_span(flags: DataFrame, ts: str = "timestamp") -> tuple[datetime | None, datetime | None, int]:
    row = flags.agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(ts).alias("n")).first()
    return row["a"], row["b"], row["n"]


def flag_volume(flags: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Flags per time bucket, oldest first. The span picks the bucket size."""
    first, last, rows = time_span(flags, ts)
    unit = volume_unit(first, last, rows) if rows else "day"
    known = flags.filter(F.col(ts).isNotNull())
    if unit == "centisecond":
        at = F.timestamp_micros(F.floor(F.unix_micros(ts) / 10_000) * 10_000)
    else:
        at = F.date_trunc(unit, F.col(ts))
    counts = known.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("_at").select(
        F.date_format("_at", LABELS[unit]).alias("bucket"), F.lit(unit).alias("unit"), "count"
    )


def span_text(first: Column, last: Column) -> Column:
    """A time span in words: 3.5s, 12m, 4.2h, 9d 3h."""
    s = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)
    whole = F.floor(s)
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm", F.floor(whole / 60)))
        .when(s < 86400, F.format_string("%.1fh", s / 3600))
        .otherwise(
            F.format_string("%dd %dh", F.floor(whole / 86400), F.floor(F.pmod(whole, F.lit(86400)) / 3600))
        )
    )


def flag_span(flags: DataFrame, ts: str = "timestamp") -> DataFrame:
    ends = flags.agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(ts).alias("flags"))
    return ends.select("flags", span_text(F.col("a"), F.col("b")).alias("span"))


def type_counts(flags: DataFrame) -> DataFrame:
    """Flags by reason type with their share, most common first."""
    counts = with_reason_type(flags).groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    total = flags.count()
    share = F.col("count") / F.lit(float(total or 1))
    return counts.withColumn("share", share).orderBy(F.desc("count"), "type")


def kpis(processed: int, flags: int, spark: SparkSession) -> DataFrame:
    """Processed, flagged, flag rate, distance from the expected rate in points, band."""
    row = spark.range(1).select(
        F.lit(processed).cast("bigint").alias("processed"), F.lit(flags).cast("bigint").alias("flagged")
    )
    rate = ratio(F.col("flagged"), F.col("processed"))
    delta = (rate - F.lit(EXPECTED_RATE)) * 100
    band = F.when(F.abs(delta) <= 1.5, "near").when(F.abs(delta) <= 3.5, "off").otherwise("far")
    return row.withColumns({"flag_rate": rate, "delta_points": delta, "band": band})


def processed_orders(log: DataFrame) -> DataFrame:
    """Orders in the feature log and the time of the last one."""
    return log.agg(F.count(F.lit(1)).alias("processed"), F.max("timestamp").alias("last_seen"))


def freshness(flags: DataFrame, log: DataFrame, now: datetime) -> DataFrame:
    """Latest activity in either table, its age, and Live while it is recent."""
    last = flags.select("timestamp").unionByName(log.select("timestamp")).agg(F.max("timestamp").alias("last"))
    age = (F.unix_micros(F.lit(now)) - F.unix_micros("last")) / F.lit(1e6)
    status = F.when(age <= LIVE_SECONDS, "Live").otherwise("Idle")
    return last.select("last", age.alias("age_seconds"), status.alias("status"))


def shown_metrics(metrics: DataFrame, spark: SparkSession) -> DataFrame:
    """Evaluation numbers to show: measured ones (3 places, half up), else the defaults."""
    defaults = spark.createDataFrame(list(METRIC_DEFAULTS.items()), "metric string, fallback double")
    measured = half_up("value", 3)
    shown = F.when(F.col("metric") == "threshold", F.col("value")).otherwise(measured)
    return defaults.join(metrics, "metric", "left").select(
        "metric",
        F.coalesce(shown, F.col("fallback")).alias("value"),
        F.col("value").isNotNull().alias("measured"),
    )
