"""Stock proxy per (product, region): restock windows, balance, days of cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orderlens.functions.exprs import elapsed_days, join_groups
from orderlens.operators.features import category_zscores, price_deviation
from orderlens.operators.ordered import CHUNK_ROWS, groups_above, ordered_groups, spread
from orderlens.sources.orders import EVENT_ORDER, PAIR_KEYS, dated_orders

RESTOCK_DAYS = 14
STOCK_MULTIPLE = 2
DEMAND_WINDOW = 7
WINDOW = "restock_window"


def window_id(date: str | Column, first: str | Column, days: int = RESTOCK_DAYS) -> Column:
    """Number of whole restock intervals since the pair's first order."""
    return F.floor(elapsed_days(date, first) / F.lit(days)).cast("bigint")


def base_stock(orders: Column, windows: Column, mean_quantity: Column, multiple: int) -> Column:
    """max(1, mean orders per non-empty window x mean quantity x multiple), half-even."""
    level = orders / windows * mean_quantity * F.lit(multiple)
    return F.greatest(F.lit(1.0), F.bround(level).cast("double"))


def with_restock_window(
    orders: DataFrame,
    days: int = RESTOCK_DAYS,
    max_rows: int | None = None,
    keep_unkeyed: bool = False,
) -> DataFrame:
    """Add ``first_order_date`` and the restock window of each order.

    While every pair fits into one task the first date is a window, so that
    later work per pair reuses its shuffle; else it is aggregated and joined.
    """
    rows = dated_orders(orders, [] if keep_unkeyed else PAIR_KEYS)
    n = rows.count()
    if groups_above(rows, PAIR_KEYS, max_rows or CHUNK_ROWS, n) is None:
        first = F.min("order_date").over(W.partitionBy(*PAIR_KEYS))
        rows = spread(rows, PAIR_KEYS, n).withColumn("first_order_date", first)
    else:
        first = rows.groupBy(*PAIR_KEYS).agg(F.min("order_date").alias("first_order_date"))
        rows = join_groups(rows, first, PAIR_KEYS)
    entered = window_id("order_date", "first_order_date", days)
    keyed = F.col(PAIR_KEYS[0]).isNotNull() & F.col(PAIR_KEYS[1]).isNotNull()
    return rows.withColumn(WINDOW, F.when(keyed, entered) if keep_unkeyed else entered)


def pair_constants(
    orders: DataFrame,
    days: int = RESTOCK_DAYS,
    multiple: int = STOCK_MULTIPLE,
    max_rows: int | None = None,
) -> DataFrame:
    """One row per pair: first order date and base stock."""
    per_window = (
        with_restock_window(orders, days, max_rows).groupBy(*PAIR_KEYS, WINDOW).agg(*window_totals())
    )
    return per_window.groupBy(*PAIR_KEYS).agg(*constants_of(multiple))


def window_totals() -> list[Column]:
    """Per (pair, window) totals from which the pair's constants follow."""
    return [
        F.count(F.lit(1)).alias("_orders"),
        F.sum("quantity").alias("_quantity"),
        F.count("quantity").alias("_known"),
        F.min("first_order_date").alias("first_order_date"),
    ]


def constants_of(multiple: int = STOCK_MULTIPLE) -> list[Column]:
    mean_quantity = F.try_divide(F.sum("_quantity"), F.sum("_known"))
    return [
        F.min("first_order_date").alias("first_order_date"),
        base_stock(F.sum("_orders"), F.count(F.lit(1)), mean_quantity, multiple).alias("base_stock"),
    ]


def _constants_in_place(groups, days: int, multiple: int):
    """Constants as whole-pair windows: no join, all windows share one exchange.

    Only for tables in which every pair is known to fit into one task.
    """
    pair = W.partitionBy(*groups.keys)
    groups = groups.with_columns({"first_order_date": F.min("order_date").over(pair)})
    groups = groups.with_columns({WINDOW: window_id("order_date", "first_order_date", days)})
    windows = F.size(F.collect_set(WINDOW).over(pair))
    mean_quantity = F.avg("quantity").over(pair)
    level = base_stock(F.count(F.lit(1)).over(pair), windows, mean_quantity, multiple)
    return groups.with_columns({"base_stock": level})


def inventory_balance(
    orders: DataFrame,
    days: int = RESTOCK_DAYS,
    multiple: int = STOCK_MULTIPLE,
    max_rows: int | None = None,
    keep_unkeyed: bool = False,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Add stock after the order, recent demand, days of cover and stock decline.

    Orders without a product or region are dropped, or kept with NULL stock.
    ``count_on`` may name a cheaper table with the same pairs to read sizes from.
    """
    rows = dated_orders(orders, [] if keep_unkeyed else PAIR_KEYS)
    groups = ordered_groups(rows, PAIR_KEYS, EVENT_ORDER, max_rows, count_on)
    if groups.split:
        constants = pair_constants(rows, days, multiple, max_rows)
        joined = join_groups(groups.rows, constants, PAIR_KEYS)
        groups = type(groups)(joined, groups.keys, groups.order, True, groups.size).with_columns(
            {WINDOW: window_id("order_date", "first_order_date", days)}
        )
    else:
        groups = _constants_in_place(groups.gathered(), days, multiple)

    groups = groups.running_sum("quantity", WINDOW, "quantity_in_window")
    # An unknown quantity leaves its own balance unknown but not the later ones.
    stock = F.when(
        F.col("quantity").isNotNull(), F.col("base_stock") - F.col("quantity_in_window")
    )
    groups = groups.with_columns({"stock_after_order": stock}).with_history(DEMAND_WINDOW)
    if groups.split:
        groups = groups.gathered()
    earlier = F.avg("quantity").over(groups.window().rowsBetween(-DEMAND_WINDOW, -1))
    previous = F.lag("stock_after_order").over(groups.window())
    groups = groups.with_columns({"recent_demand": earlier, "_previous": previous})
    demand = F.coalesce("recent_demand", "quantity")
    cover = F.when(demand > 0, F.col("stock_after_order") / demand)
    decline = F.coalesce(F.col("_previous") - F.col("stock_after_order"), F.lit(0.0))
    added = {
        "days_of_cover_remaining": cover,
        "stock_decline_rate": decline,
        "recent_demand": demand,
        "stock_after_order": F.col("stock_after_order"),
    }
    if keep_unkeyed:
        keyed = F.col(PAIR_KEYS[0]).isNotNull() & F.col(PAIR_KEYS[1]).isNotNull()
        added = {name: F.when(keyed, c) for name, c in added.items()}
    return groups.done().withColumns(added).drop("_previous")


def offline_reference(
    orders: DataFrame, max_rows: int | None = None, stocked: DataFrame | None = None
) -> DataFrame:
    """The five model features of every dated order, computed in batch.

    ``stocked`` may hold the same orders, all dated, with their price baseline and stock.
    """
    rows = dated_orders(orders)
    if stocked is not None:
        return category_zscores(price_deviation(stocked, baseline="baseline").drop("baseline"), rows)
    priced = price_deviation(rows, max_rows=max_rows).drop("price_baseline")
    # The z-scores come last, so that they are not shuffled by pair.
    return category_zscores(inventory_balance(priced, max_rows=max_rows, keep_unkeyed=True, count_on=rows), rows)
