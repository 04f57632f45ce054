"""Batch signals of an order: rolling price baseline and category z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.functions.exprs import join_groups, sorted_median, zscore
from orderlens.operators.ordered import ordered_groups
from orderlens.operators.quantiles import grouped_percentiles
from orderlens.session import materialise, settle
from orderlens.sources.orders import EVENT_ORDER, PRICE_KEYS

PRICE_WINDOW = 30
CATEGORY = ["category_name"]

# Names of the five model features, in model order.
FEATURES = [
    "price_deviation_from_supplier_category_avg",
    "delivery_delay_deviation",
    "discount_rate_anomaly",
    "stock_after_order",
    "days_of_cover_remaining",
]
PRICE_FEATURE = FEATURES[0]


def price_baseline(
    orders: DataFrame, window: int = PRICE_WINDOW, max_rows: int | None = None
) -> DataFrame:
    """Add ``price_baseline``: median price of up to ``window`` earlier orders of
    the same supplier and category; an order without history is its own baseline."""
    groups = ordered_groups(orders, PRICE_KEYS, EVENT_ORDER, max_rows).with_history(window).gathered()
    earlier = groups.window().rowsBetween(-window, -1)
    # A sorted array of <= 30 values is cheaper than a sliding percentile aggregate.
    groups = groups.with_columns({"_earlier": F.collect_list("price").over(earlier)})
    groups = groups.with_columns(
        {"price_baseline": F.coalesce(sorted_median(F.col("_earlier")), F.col("price"))}
    )
    return groups.done().drop("_earlier")


def price_deviation(
    orders: DataFrame,
    window: int = PRICE_WINDOW,
    baseline: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add the price deviation, from the rolling baseline or a given column."""
    if baseline is None:
        orders, baseline = price_baseline(orders, window, max_rows), "price_baseline"
    return orders.withColumn(PRICE_FEATURE, F.col("price") - F.col(baseline))


def delivery_delay(orders: DataFrame) -> DataFrame:
    return orders.withColumn("delivery_delay_days", F.col("days_real") - F.col("days_scheduled"))


def group_zscores(df: DataFrame, keys: list[str], columns: dict[str, str], over: DataFrame | None = None) -> DataFrame:
    """Add z-scores (population spread) of ``{output: input}`` columns within ``keys``.

    Statistics come from a combinable aggregate joined back, not from a
    whole-group window, so a group of any size is spread over all tasks.
    ``over`` may name a cheaper table with the same rows to take them from.
    """
    stats = (df if over is None else over).groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{out}") for out, c in columns.items()],
        *[F.stddev_pop(c).alias(f"_std_{out}") for out, c in columns.items()],
    )
    joined = join_groups(df, materialise(stats, "group_stats"), keys)
    scored = {out: zscore(c, f"_mean_{out}", f"_std_{out}") for out, c in columns.items()}
    return joined.withColumns(scored).drop(*[c for c in stats.columns if c not in keys])


def quantity_zscore(orders: DataFrame) -> DataFrame:
    return group_zscores(orders, CATEGORY, {"order_quantity_zscore_by_category": "quantity"})


def delivery_zscore(orders: DataFrame) -> DataFrame:
    return group_zscores(
        delivery_delay(orders), CATEGORY, {"delivery_delay_deviation": "delivery_delay_days"}
    )


def discount_zscore(orders: DataFrame) -> DataFrame:
    return group_zscores(orders, CATEGORY, {"discount_rate_anomaly": "discount_rate"})


def category_zscores(orders: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Quantity, delay and discount-rate z-scores with one pass over the statistics, which may come from ``over``."""
    return group_zscores(
        delivery_delay(orders),
        CATEGORY,
        {
            "order_quantity_zscore_by_category": "quantity",
            "delivery_delay_deviation": "delivery_delay_days",
            "discount_rate_anomaly": "discount_rate",
        },
        None if over is None else delivery_delay(over),
    )


def robust_zscore(
    df: DataFrame, keys: list[str], value: str, name: str, max_rows: int | None = None
) -> DataFrame:
    """Add (x - median) / (1.4826 MAD) within ``keys``; 0 where the MAD is 0."""
    medians = settle(grouped_percentiles(df, keys, {"_median": (value, 0.5)}, max_rows))
    centred = join_groups(df, medians, keys)
    centred = centred.withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    mads = grouped_percentiles(centred, keys, {"_mad": ("_off", 0.5)}, max_rows)
    mads = settle(mads.withColumn("_scale", F.lit(1.4826) * F.col("_mad")))
    scored = join_groups(centred, mads, keys)
    return scored.withColumn(name, zscore(value, "_median", "_scale")).drop(
        "_median", "_off", "_mad", "_scale"
    )


def feature_table(
    orders: DataFrame, window: int = PRICE_WINDOW, max_rows: int | None = None
) -> DataFrame:
    """All order-level signals: price deviation, delay, and the three z-scores."""
    return category_zscores(price_deviation(orders, window, max_rows=max_rows)).drop("price_baseline")
