"""Labelled test set: clean orders with three families of injected anomalies.

All draws are hashes of row ids, so the table is the same on every run and for
every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orderlens.functions.exprs import hash60, join_groups, micros, uniform
from orderlens.operators.features import PRICE_FEATURE, category_zscores, price_baseline
from orderlens.operators.inventory import RESTOCK_DAYS, WINDOW, inventory_balance
from orderlens.operators.ordered import CHUNK_ROWS, groups_above
from orderlens.operators.quantiles import grouped_percentiles
from orderlens.operators.sampling import SEED, disjoint_subsets, running_total_by_hash
from orderlens.session import materialise, settle
from orderlens.sources.orders import EVENT_ORDER, PAIR_KEYS, dated_orders

# The anomaly families and the size of each injection.
ANOMALY_TYPES = ["price_spike", "delivery_delay", "inventory_depletion"]
NORMAL = "normal"
FRACTION = 0.015
SPIKE_RANGE = (1.25, 1.50)
DELAY_RANGE = (10, 15)
BURST_RANGE = (3, 5)

WINDOW_KEYS = [*PAIR_KEYS, WINDOW]
SEEDED = "seeded_pair"
STOCK_COLUMNS = ["stock_after_order", "days_of_cover_remaining", "stock_decline_rate"]


def label_subsets(orders: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``subset``: 0 spike, 1 delay, 2 burst seed, NULL untouched. Sizes are exact."""
    size = max(1, round(fraction * orders.count()))
    return disjoint_subsets(orders, [size] * 3, "subset", "order_item_id", "subset", seed)


def spiked_price(seed: int = SEED) -> Column:
    low, high = SPIKE_RANGE
    return F.col("price") * (low + (high - low) * uniform(seed, "spike", "order_item_id"))


def delayed_days(seed: int = SEED) -> Column:
    low, high = DELAY_RANGE
    return F.col("days_real") + low + F.floor((high - low + 1) * uniform(seed, "delay", "order_item_id"))


def row_labels() -> dict[str, Column]:
    """The labels that a row of the given orders has in the labelled table, from its subset."""
    spike, delay = F.col("subset") == 0, F.col("subset") == 1
    kind = F.when(spike, ANOMALY_TYPES[0]).when(delay, ANOMALY_TYPES[1]).otherwise(NORMAL)
    return {"is_anomaly": F.when(spike | delay, 1).otherwise(0), "anomaly_type": kind}


def inject_rows(subsets: DataFrame, seed: int = SEED) -> DataFrame:
    """Change the prices and delays of the chosen rows and label them."""
    spike, delay = F.col("subset") == 0, F.col("subset") == 1
    return subsets.withColumns(
        {
            "clean_days_real": F.col("days_real"),
            "price": F.when(spike, spiked_price(seed)).otherwise(F.col("price")),
            "days_real": F.when(delay, delayed_days(seed)).otherwise(F.col("days_real")),
            **row_labels(),
        }
    )


def window_stats(rows: DataFrame, keys: list[str] = WINDOW_KEYS, max_rows: int | None = None) -> DataFrame:
    """Per restock window: the ranges and medians that burst rows are drawn from."""
    ranges = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"),
        F.min("quantity").alias("min_quantity"),
        F.max("quantity").alias("max_quantity"),
        F.avg("quantity").alias("mean_quantity"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.min("discount").alias("min_discount"),
        F.max("discount").alias("max_discount"),
        F.min("discount_rate").alias("min_rate"),
        F.max("discount_rate").alias("max_rate"),
        F.min("order_date").alias("window_start"),
        F.max("order_date").alias("window_end"),
    )
    medians = grouped_percentiles(
        rows, keys, {"median_quantity": ("quantity", 0.5), "median_price": ("price", 0.5)}, max_rows
    )
    return join_groups(ranges, medians, keys, "inner")


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest row of each group, without sorting any group."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*EVENT_ORDER)).alias("r")
    return rows.groupBy(*keys).agg(first).select(*keys, "r.*")


def burst_rows(changed: DataFrame, seed: int = SEED, max_rows: int | None = None) -> DataFrame:
    """3 to 5 extra orders for every restock window that holds a burst seed.

    ``changed`` carries ``subset``, the restock window and the injected prices.
    New ids continue from the highest ones.
    """
    seeds = changed.filter((F.col("subset") == 2) & F.col(WINDOW).isNotNull())
    windows = settle(seeds.select(*WINDOW_KEYS).distinct())
    near = changed.filter(SEEDED) if SEEDED in changed.columns else changed
    members = materialise(join_groups(near, windows, WINDOW_KEYS, "left_semi"), "members")
    stats = window_stats(members, max_rows=max_rows)
    plain = ["order_id", "order_item_id", "order_date", "supplier", "category_name"]
    plain += ["days_scheduled", "discount", "discount_rate", "clean_days_real"]
    template = first_rows(members.select(*WINDOW_KEYS, *plain), WINDOW_KEYS)
    seeded = join_groups(template.drop("order_id", "order_item_id", "order_date"), stats, WINDOW_KEYS, "inner")

    def draw(salt: str, *ids: str) -> Column:
        return uniform(seed, salt, *WINDOW_KEYS, *ids)

    low, high = BURST_RANGE
    sized = seeded.withColumn(
        "burst_size", (low + F.floor((high - low + 1) * draw("burst_size"))).cast("bigint")
    )
    numbered = running_total_by_hash(
        sized, hash60(seed, "burst_id", *WINDOW_KEYS), WINDOW_KEYS, "burst_size", "_before"
    )
    item = F.col("order_item_id")
    number = F.when(item.rlike("^[0-9]{1,18}$"), item.cast("bigint"))
    top = changed.agg(
        F.max("order_id").alias("order_id"),
        F.max(number).alias("item_id"),
    ).first()
    top_item = top["item_id"] if top["item_id"] is not None else top["order_id"]

    rows = numbered.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("burst_size").cast("int"))))
    middle = F.when(F.col("median_quantity") > 0, F.col("median_quantity")).otherwise(F.col("mean_quantity"))
    centre = F.bround(middle)
    floor0 = F.greatest(F.lit(1.0), F.floor("min_quantity") - F.lit(1.0))
    least = F.greatest(F.lit(1.0), F.least(floor0, centre))
    most = F.greatest(centre + 1, floor0 + 1, F.ceil("max_quantity") + F.lit(1.0))
    price = F.col("median_price")
    jitter = F.greatest(
        F.abs(F.col("max_price") - F.col("min_price")) * 0.05, price * 0.02, F.lit(0.05)
    )
    swing = lambda salt: draw(salt, "i") * 2 - 1
    clip = lambda x, a, b: F.least(F.greatest(x, a), b)
    zero = F.lit(0.0)

    def near(value: str, low: str, high: str, floor: float, salt: str) -> Column:
        span = F.greatest((F.col(high) - F.col(low)) * 0.5, F.lit(floor))
        moved = F.coalesce(F.col(value), zero) + swing(salt) * span
        return clip(moved, F.greatest(zero, F.col(low)), F.greatest(zero, F.col(high)))

    step = F.expr("((unix_micros(window_end) - unix_micros(window_start)) * i) div (burst_size + 1)")
    when = F.date_trunc("minute", F.timestamp_micros(micros("window_start") + step))
    rank = F.col("_before") + F.col("i")
    return rows.select(
        (F.lit(top["order_id"]) + rank).alias("order_id"),
        (F.lit(top_item) + rank).cast("string").alias("order_item_id"),
        *[F.col(c) for c in PAIR_KEYS],
        "supplier",
        "category_name",
        clip(price + swing("burst_price") * jitter, F.greatest(F.col("min_price") - jitter, zero), F.col("max_price") + jitter).alias("price"),
        (least + F.floor((most - least + 1) * draw("burst_quantity", "i"))).alias("quantity"),
        F.col("clean_days_real").alias("days_real"),
        "days_scheduled",
        near("discount", "min_discount", "max_discount", 0.5, "burst_discount").alias("discount"),
        near("discount_rate", "min_rate", "max_rate", 0.01, "burst_rate").alias("discount_rate"),
        when.alias("order_date"),
        price.alias("baseline"),
        F.lit(1).alias("is_anomaly"),
        F.lit(ANOMALY_TYPES[2]).alias("anomaly_type"),
    )


def changed_orders(
    orders: DataFrame,
    seed: int = SEED,
    fraction: float = FRACTION,
    max_rows: int | None = None,
) -> DataFrame:
    """Clean orders plus frozen baseline, subset and injected values."""
    frozen = price_baseline(orders, max_rows=max_rows).withColumnRenamed("price_baseline", "baseline")
    return inject_rows(label_subsets(frozen, fraction, seed), seed)


def stocked_orders(
    orders: DataFrame,
    seed: int = SEED,
    fraction: float = FRACTION,
    max_rows: int | None = None,
    days: int = RESTOCK_DAYS,
) -> DataFrame:
    """Dated clean orders with subset, frozen baseline, restock window and stock; ``SEEDED`` says
    whether their pair holds a burst seed.

    The labelled table and the batch reference both start from it, so whole rows pass
    two ordered shuffles, one by price group and one by pair.
    """
    priced = price_baseline(label_subsets(orders, fraction, seed), max_rows=max_rows)
    priced = priced.withColumnRenamed("price_baseline", "baseline")
    stocked = inventory_balance(priced, days, max_rows=max_rows, keep_unkeyed=True, count_on=orders)
    keyed = F.col(PAIR_KEYS[0]).isNotNull() & F.col(PAIR_KEYS[1]).isNotNull()
    stocked = stocked.withColumn(WINDOW, F.when(keyed, F.col(WINDOW)))
    stocked = stocked.drop("base_stock", "first_order_date", "quantity_in_window", "recent_demand")
    seed_row = (F.col("subset") == 2) & keyed
    if groups_above(orders, PAIR_KEYS, max_rows or CHUNK_ROWS) is None:
        seeded = F.max(seed_row).over(W.partitionBy(*PAIR_KEYS))
        return stocked.withColumn(SEEDED, F.coalesce(seeded, F.lit(False)))
    pairs = dated_orders(label_subsets(orders, fraction, seed)).filter(seed_row).select(*PAIR_KEYS).distinct()
    return join_groups(stocked, pairs.withColumn(SEEDED, F.lit(True)), PAIR_KEYS).na.fill(False, subset=[SEEDED])


def labelled_orders(
    orders: DataFrame,
    seed: int = SEED,
    fraction: float = FRACTION,
    max_rows: int | None = None,
    days: int = RESTOCK_DAYS,
    stocked: DataFrame | None = None,
) -> DataFrame:
    """The labelled table: features, stock and labels of changed and burst orders.

    Price deviation is taken against the clean baseline (burst rows: the window's
    median price), so injected prices do not leak into it; z-scores and stock are
    recomputed on the changed table. No quantity of an order is changed, so the stock
    of a pair without bursts stays that of the clean orders. ``stocked`` may
    name ``stocked_orders`` of the same arguments, already written.
    """
    if stocked is None:
        stocked = materialise(stocked_orders(orders, seed, fraction, max_rows, days), "stocked")
    changed = inject_rows(stocked, seed)
    bursts = materialise(burst_rows(changed, seed, max_rows), "bursts")
    with_bursts = changed.filter(SEEDED).select(*bursts.columns).unionByName(bursts)
    columns = [*bursts.columns, *STOCK_COLUMNS]
    anew = inventory_balance(with_bursts, days, max_rows=max_rows, keep_unkeyed=True).select(*columns)
    full = changed.filter(~F.col(SEEDED)).select(*columns).unionByName(materialise(anew, "burst_pairs"))
    # Deviation and z-scores come last, so that they are not shuffled by pair.
    labelled = category_zscores(full.withColumn(PRICE_FEATURE, F.col("price") - F.col("baseline")), full)
    return labelled.na.fill(0.0, subset=STOCK_COLUMNS).drop("baseline")


def anomaly_summary(labelled: DataFrame) -> DataFrame:
    """Rows and percent of the table by anomaly type."""
    counts = labelled.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))
    total = labelled.count()
    return counts.withColumn("percent", F.col("count") / F.lit(float(total)) * 100)


def label_check(labelled: DataFrame) -> DataFrame:
    """Flag sum per type and the number of rows flagged more than once (must be 0)."""
    return labelled.groupBy("anomaly_type").agg(
        F.sum("is_anomaly").alias("flagged"),
        F.count(F.when(F.col("is_anomaly") > 1, 1)).alias("overlapping"),
    )
