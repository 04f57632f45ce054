"""State of the live job, computed from history in batch.

Statistics and pair constants come from all historical rows. What a live order
would see as "earlier" (recent prices, stock used, recent quantities) leaves out
the orders that will be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from orderlens.functions.exprs import finite, join_groups
from orderlens.operators.features import CATEGORY, PRICE_WINDOW, delivery_delay
from orderlens.operators.inventory import (
    DEMAND_WINDOW,
    RESTOCK_DAYS,
    WINDOW,
    constants_of,
    window_totals,
    with_restock_window,
)
from orderlens.session import materialise
from orderlens.sources.orders import EVENT_ORDER, PAIR_KEYS, PRICE_KEYS, dated_orders


def without_ids(orders: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose item id is not in ``ids``."""
    if ids is None:
        return orders
    return orders.join(ids.select("order_item_id"), "order_item_id", "left_anti")


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct item ids found in both tables."""
    return a.select("order_item_id").intersect(b.select("order_item_id"))


def frozen_stats(history: DataFrame) -> DataFrame:
    """Per category: mean and population spread of delay and discount rate.

    A spread over fewer than two values is 0.
    """

    def spread(c: str):
        return F.when(F.count(c) > 1, F.stddev_pop(c)).otherwise(F.lit(0.0))

    return (
        delivery_delay(history)
        .groupBy(*CATEGORY)
        .agg(
            F.coalesce(F.avg("delivery_delay_days"), F.lit(0.0)).alias("delay_mean"),
            spread("delivery_delay_days").alias("delay_std"),
            F.coalesce(F.avg("discount_rate"), F.lit(0.0)).alias("discount_mean"),
            spread("discount_rate").alias("discount_std"),
        )
    )


def _tail(rows: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """Last ``n`` values of each group, oldest first.

    The row-number limit is applied before the shuffle too, so a group of any
    size sends at most ``n`` rows per task.
    """
    latest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in EVENT_ORDER])
    kept = rows.select(*keys, *EVENT_ORDER, F.col(value).alias("_value"))
    kept = kept.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("_value").alias("v"))))
    return kept.groupBy(*keys).agg(listed.getField("v").alias(name))


REPLAYED = "_replayed"


def mark_replayed(history: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Add ``_replayed``: whether the order is in ``ids``."""
    if ids is None:
        return history.withColumn(REPLAYED, F.lit(False))
    marks = ids.select("order_item_id").distinct().withColumn(REPLAYED, F.lit(True))
    joined = history.join(marks, "order_item_id", "left")
    return joined.withColumn(REPLAYED, F.coalesce(REPLAYED, F.lit(False)))


def _marked(history: DataFrame, ids: DataFrame | None) -> DataFrame:
    return history if REPLAYED in history.columns else mark_replayed(history, ids)


def price_tail(history: DataFrame, ids: DataFrame | None = None, n: int = PRICE_WINDOW) -> DataFrame:
    """Last ``n`` known prices per (supplier, category)."""
    rows = _marked(dated_orders(history), ids).filter(~F.col(REPLAYED) & finite("price").isNotNull())
    return _tail(rows, PRICE_KEYS, "price", n, "prices")


def inventory_tail(
    history: DataFrame,
    ids: DataFrame | None = None,
    days: int = RESTOCK_DAYS,
    n: int = DEMAND_WINDOW,
    max_rows: int | None = None,
) -> DataFrame:
    """Per pair: constants, last restock window, quantity used in it, last quantities."""
    rows = _marked(dated_orders(history, PAIR_KEYS), ids)
    earlier = ~F.col(REPLAYED)
    per_window = (
        with_restock_window(rows, days, max_rows)
        .groupBy(*PAIR_KEYS, WINDOW)
        .agg(
            *window_totals(),
            F.count(F.when(earlier, 1)).alias("_earlier"),
            F.sum(F.when(earlier, F.col("quantity"))).alias("_used"),
        )
    )
    last = F.when(F.col("_earlier") > 0, F.col(WINDOW))
    pairs = per_window.groupBy(*PAIR_KEYS).agg(
        *constants_of(), F.max(last).alias("last_window"), F.max_by("_used", last).alias("used")
    )
    recent = _tail(rows.filter(earlier), PAIR_KEYS, "quantity", n, "quantities")
    return join_groups(pairs, recent, PAIR_KEYS).withColumns(
        {
            "last_window": F.coalesce("last_window", F.lit(0).cast("bigint")),
            "used": F.coalesce("used", F.lit(0.0)),
            "quantities": F.coalesce("quantities", F.array().cast("array<double>")),
        }
    )


def seed_tables(
    history: DataFrame, ids: DataFrame | None = None, max_rows: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics, price tails and inventory tails, each written once.

    The replayed orders are looked up once for both tails.
    """
    needed = [*dict.fromkeys([*PRICE_KEYS, *PAIR_KEYS, *EVENT_ORDER, "price", "quantity"])]
    marked = materialise(mark_replayed(dated_orders(history).select(*needed), ids), "marked")
    return (
        materialise(frozen_stats(history), "stats"),
        materialise(price_tail(marked), "prices"),
        materialise(inventory_tail(marked, max_rows=max_rows), "inventory"),
    )
