import numpy as np
import pandas as pd
import pytest
from conftest import equal_rows
from pyspark.sql import functions as F

from orderlens.functions.exprs import close_to, elapsed_days, parse_order_date
from orderlens.operators.features import (
    FEATURES,
    PRICE_FEATURE,
    feature_table,
    group_zscores,
    price_baseline,
    robust_zscore,
)
from orderlens.operators.inventory import inventory_balance, offline_reference, pair_constants
from orderlens.operators.ordered import ordered_groups
from orderlens.operators import ordered, quantiles
from orderlens.operators.quantiles import grouped_percentiles, percentile_values
from orderlens.session import materialise
from orderlens.sources.orders import EVENT_ORDER, ORDER_SCHEMA, PRICE_KEYS


def small_orders(spark, rows):
    """Rows as dicts over the order schema; what is left out is NULL."""
    names = [f.name for f in ORDER_SCHEMA]
    base = {"supplier": "West", "order_region": "West", "category_name": "Office", "product_id": 1}
    tuples = []
    for i, row in enumerate(rows):
        full = {**base, "order_id": i, "order_item_id": str(i), **row}
        full["order_date"] = pd.Timestamp(full["order_date"]).to_pydatetime()
        tuples.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(tuples, ORDER_SCHEMA)


@pytest.fixture(scope="module")
def five(spark):
    data = [
        ("2024-01-01", "West", 10, 5, 4, 3, 0.05),
        ("2024-01-02", "West", 12, 6, 5, 3, 0.05),
        ("2024-01-03", "East", 9, 7, 6, 4, 0.10),
        ("2024-01-04", "East", 11, 8, 7, 4, 0.15),
        ("2024-01-05", "West", 14, 9, 8, 5, 0.20),
    ]
    keys = ["order_date", "supplier", "price", "quantity", "days_real", "days_scheduled", "discount_rate"]
    typed = [dict(zip(keys, [d[0], d[1], *map(float, d[2:])])) for d in data]
    return small_orders(spark, typed)


def test_five_row_sample(five):
    got = feature_table(five).orderBy("order_id").toPandas()
    assert got[PRICE_FEATURE].tolist() == [0, 2, 0, 2, 3]
    assert np.allclose(got["order_quantity_zscore_by_category"], (np.arange(5, 10) - 7) / np.sqrt(2))
    assert got["delivery_delay_days"].tolist() == [1, 2, 2, 3, 3]
    expected = [-1.60357, -0.26726, -0.26726, 1.06904, 1.06904]
    assert np.allclose(got["delivery_delay_deviation"], expected, atol=1e-5)


def test_constant_category_scores_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), (None, 1.0), (None, 3.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["z"] for r in group_zscores(df, ["k"], {"z": "x"}).collect()}
    assert got == {("a", 2.0): 0.0, (None, 1.0): -1.0, (None, 3.0): 1.0}


def test_null_price_counts_in_the_frame_but_not_in_the_median(spark):
    rows = [{"order_date": f"2024-01-0{i + 1}", "price": p} for i, p in enumerate([10.0, None, 20.0, 7.0])]
    got = price_baseline(small_orders(spark, rows)).orderBy("order_id").toPandas()["price_baseline"]
    assert got.tolist() == [10.0, 10.0, 10.0, 15.0]


def test_robust_zscore_with_zero_mad(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 9.0)] + [("b", x) for x in (1.0, 2.0, 4.0)], "k string, x double")
    got = sorted(robust_zscore(df, ["k"], "x", "z").collect())
    assert [r["z"] for r in got if r["k"] == "a"] == [0.0] * 4
    assert np.allclose([r["z"] for r in got if r["k"] == "b"], [-1 / 1.4826, 0, 2 / 1.4826])


def test_restock_window_counts_elapsed_days(spark):
    rows = [
        {"order_date": "2024-01-01 12:00", "quantity": 1.0},
        {"order_date": "2024-01-15 11:00", "quantity": 2.0},
        {"order_date": "2024-01-15 12:00", "quantity": 4.0},
    ]
    got = inventory_balance(small_orders(spark, rows)).orderBy("order_id").toPandas()
    assert got["restock_window"].tolist() == [0, 0, 1]
    # two windows, 1.5 orders each, mean quantity 7/3, times 2
    assert got["base_stock"].tolist() == [7.0] * 3
    assert got["stock_after_order"].tolist() == [6.0, 4.0, 3.0]
    assert got["recent_demand"].tolist() == [1.0, 1.0, 1.5]
    assert got["stock_decline_rate"].tolist() == [0.0, 2.0, 1.0]


@pytest.mark.parametrize("max_rows", [400, 60])
def test_cut_groups_give_the_same_baseline(skewed, max_rows):
    equal_rows(price_baseline(skewed, max_rows=max_rows), price_baseline(skewed), ["price_baseline"])


@pytest.mark.parametrize("max_rows", [400, 60])
def test_cut_groups_give_the_same_stock(skewed, max_rows):
    columns = ["base_stock", "stock_after_order", "days_of_cover_remaining", "stock_decline_rate"]
    equal_rows(inventory_balance(skewed, max_rows=max_rows), inventory_balance(skewed), columns)


def test_no_chunk_is_much_larger_than_asked(skewed):
    groups = ordered_groups(skewed, PRICE_KEYS, EVENT_ORDER, 60)
    assert groups.split
    largest = groups.rows.groupBy(*groups.partition).count().agg(F.max("count")).first()[0]
    assert largest < 4 * 60


def test_cut_constants(skewed):
    a, b = pair_constants(skewed, max_rows=60), pair_constants(skewed)
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_results_do_not_depend_on_partitioning(skewed):
    one, many = offline_reference(skewed.coalesce(1)), offline_reference(skewed.repartition(64))
    equal_rows(one, many, FEATURES)


def test_orders_without_a_pair_keep_null_stock(spark):
    rows = [
        {"order_date": "2024-01-01", "price": 1.0, "quantity": 1.0},
        {"order_date": "2024-01-02", "price": 2.0, "quantity": 1.0, "product_id": None},
    ]
    got = offline_reference(small_orders(spark, rows)).orderBy("order_id").toPandas()
    assert got["stock_after_order"].isna().tolist() == [False, True]
    assert got[PRICE_FEATURE].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("p", [0.0, 0.013, 0.5, 0.935, 1.0])
def test_percentiles_beyond_the_direct_size(skewed, p):
    x = skewed.select("price").toPandas()["price"]
    got = percentile_values(skewed, {"v": ("price", p)}, max_rows=100)["v"]
    assert got == pytest.approx(np.percentile(x, 100 * p))


def test_grouped_percentiles_with_hot_groups(skewed):
    wanted = {"a": ("price", 0.5), "b": ("discount_rate", 0.9)}
    got = grouped_percentiles(skewed, ["supplier"], wanted, max_rows=1500, accuracy=500)
    direct = grouped_percentiles(skewed, ["supplier"], wanted)
    x = got.toPandas().set_index("supplier").sort_index()
    y = direct.toPandas().set_index("supplier").sort_index()
    assert np.allclose(x, y)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.935, 1.0])
def test_percentiles_after_several_rounds(skewed, p, monkeypatch):
    rounds = []
    plain = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: rounds.append(1) or plain(*a))
    monkeypatch.setattr(quantiles, "CELLS", 4)
    # A sketch this coarse brackets most of the values; one value makes up a third of the rows.
    heavy = skewed.withColumn("price", F.when(F.col("order_id") % 3 == 0, F.lit(1000.0)).otherwise(F.col("price")))
    got = grouped_percentiles(heavy, [], {"v": ("price", p)}, max_rows=100, accuracy=8, picked_from=20).first()["v"]
    assert got == pytest.approx(np.percentile(heavy.select("price").toPandas()["price"], 100 * p))
    assert len(rounds) >= 2


def test_grouped_percentiles_after_several_rounds(skewed):
    wanted = {"a": ("price", 0.5), "b": ("discount_rate", 0.9), "c": ("price", 0.99)}
    got = grouped_percentiles(skewed, ["supplier"], wanted, max_rows=100, accuracy=8, picked_from=10)
    direct = grouped_percentiles(skewed, ["supplier"], wanted)
    x = got.toPandas().set_index("supplier").sort_index()
    y = direct.toPandas().set_index("supplier").sort_index()
    assert np.allclose(x, y)


def test_dates_mixed_formats(spark):
    df = spark.createDataFrame([("1/31/2018 22:56",), ("2018-01-31 22:56:00",), ("soon",)], "d string")
    got = [r[0] for r in df.select(parse_order_date("d")).collect()]
    assert got[0] == got[1] and got[2] is None


def test_elapsed_days_round_down(spark):
    df = spark.createDataFrame(
        [("2024-01-01 23:00", "2024-01-02 01:00"), ("2024-01-02 01:00", "2024-01-01 23:00")], "a string, b string"
    ).select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert [r[0] for r in df.select(elapsed_days("b", "a")).collect()] == [0, -1]


def test_close_to(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-7), (1.0, 1.1), (None, None), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(close_to(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_split_rows_are_all_kept(skewed):
    out = materialise(price_baseline(skewed, max_rows=60))
    assert out.count() == skewed.count()
    assert out.select("order_item_id").distinct().count() == skewed.count()


def test_groups_above_is_exact_where_hashes_meet(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "HASHED", 3)
    for limit in (20, 100):
        want = skewed.groupBy("product_id", "order_region").count().filter(F.col("count") > limit).drop("count")
        got = ordered.groups_above(skewed, ["product_id", "order_region"], limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ordered.groups_above(skewed, ["order_item_id"], 5) is None


def test_zscores_are_not_shuffled_with_the_orders(orders):
    plan = offline_reference(orders)._jdf.queryExecution().optimizedPlan().toString()
    added = " AS delivery_delay_deviation#"
    assert added in plan and added not in plan[plan.index("Window [") :]


def test_large_tables_are_dealt_to_tasks_of_bounded_size(orders, monkeypatch):
    whole = materialise(inventory_balance(price_baseline(orders)), "whole")
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    parts = -(-orders.count() // 500)
    assert price_baseline(orders).rdd.getNumPartitions() == parts
    assert inventory_balance(orders).rdd.getNumPartitions() == parts
    equal_rows(inventory_balance(price_baseline(orders)), whole, ["price_baseline", "stock_after_order"])


def test_groups_are_cut_well_below_what_a_day_may_hold(skewed, monkeypatch):
    whole = materialise(price_baseline(skewed), "whole")
    stock = materialise(inventory_balance(skewed), "stock")
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 60)
    groups = ordered_groups(skewed, PRICE_KEYS, EVENT_ORDER)
    assert groups.split
    equal_rows(price_baseline(skewed), whole, ["price_baseline"])
    equal_rows(inventory_balance(skewed), stock, ["stock_after_order", "recent_demand", "stock_decline_rate"])
    # History comes from the last days of a chunk only, and every chunk but a group's first has all of it.
    last = groups.rows.filter(F.col(ordered.LAST) > 0)
    assert last.filter(F.col(ordered.AFTER) < 5).count() < 0.7 * last.count()
    history = groups.with_history(5).rows.filter(F.col(ordered.HISTORY)).groupBy(*groups.partition).count()
    later = last.select(*groups.partition).filter(F.col(ordered.CHUNK) > 1).distinct()
    assert history.filter("count >= 5").join(later, groups.partition).count() == later.count()
