import warnings

import pytest
from pyspark.sql import functions as F

from orderlens.sources.orders import read_orders_csv, star_orders, star_table, supplier_column, time_column, typed_orders
from orderlens.sources.stream import PAYLOAD, envelope, open_envelope
from orderlens.sources.tables import FlagIncrements, load_manifest, read_feature_log, read_flags, write_batch

HEADER = (
    "Order Id,Order Item Id,Product Card Id,Order Region,Category Name,Order Item Product Price,"
    "Order Item Quantity,Days for shipping (real),Days for shipment (scheduled),Order Item Discount Rate,"
    "order date (DateOrders)"
)


def test_csv_is_latin1_and_lenient(spark, tmp_path):
    text = HEADER + "\n1,10,7,Am\xe9rica,Golf,12.5,2,3,4,0.05,1/31/2018 22:56\n2,11,x,West,Golf,abc,1,3,4,nan,soon\n"
    (tmp_path / "o.csv").write_bytes(text.encode("latin1"))
    a, b = read_orders_csv(spark, str(tmp_path / "o.csv")).orderBy("order_id").collect()
    assert a["order_region"] == a["supplier"] == "Am\xe9rica"
    assert (a["price"], str(a["order_date"])) == (12.5, "2018-01-31 22:56:00")
    assert b["price"] is b["product_id"] is b["discount_rate"] is b["order_date"] is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Order Item Id"):
        typed_orders(spark.createDataFrame([("1/1/2018 1:00",)], "`order date (DateOrders)` string"))


def test_column_resolution_order():
    assert supplier_column(["Order Region", "Supplier ID"]) == "Supplier ID"
    assert time_column(["Date", "order date (DateOrders)"]) == "order date (DateOrders)"
    with pytest.raises(ValueError):
        supplier_column(["x"])
    with pytest.raises(ValueError):
        time_column(["x"])


def test_line_items_are_shuffled_for_their_orders_only(spark):
    sf = "/root/testdata/sf0.01"
    orders = star_orders(spark, sf)
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(l_partkey" not in plan
    suppliers = {r["n_nationkey"]: r["r_name"] for r in star_table(spark, sf, "nation").join(
        star_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()}
    region = {r["s_suppkey"]: suppliers[r["s_nationkey"]] for r in star_table(spark, sf, "supplier").collect()}
    lines = star_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    want = sorted((f"{a}-{b}-{c}-{d}", region[d]) for a, b, c, d in lines)
    assert sorted((r[0], r[1]) for r in orders.select("order_item_id", "order_region").collect()) == want
    dealt = star_orders(spark, sf, 1000)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "RoundRobin" not in plan and "l_tax" not in plan
    assert dealt.exceptAll(orders).count() == 0 and dealt.count() == orders.count()


def test_envelope_round_trip(spark, orders):
    labelled = orders.withColumn("is_anomaly", F.lit(1)).withColumn("row_index", F.col("order_id"))
    message = envelope(labelled, "row_index")
    names = spark.read.json(message.limit(50).rdd.map(lambda r: r[0])).select("payload.*").columns
    assert set(names) == set(PAYLOAD)
    columns = ["order_item_id", "product_id", "supplier", "price", "quantity", "order_date"]
    back = open_envelope(message).select(*columns)
    assert back.exceptAll(orders.select(*columns)).count() == 0
    assert back.count() == orders.count()


def test_broken_messages_are_dropped(spark):
    df = spark.createDataFrame([("not json",), ('{"order_id": "1", "payload": {}}',)], "value string")
    assert open_envelope(df).count() == 0


def test_retried_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "flags")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "order_id string, anomaly_score double")
    write_batch(one, path, 0)
    write_batch(one, path, 1)
    write_batch(one.limit(1), path, 1)
    assert sorted(r["batch_id"] for r in read_flags(spark, path).collect()) == [0, 0, 1]


def test_increments_take_each_batch_once(spark, tmp_path):
    path, rows = str(tmp_path / "flags"), spark.createDataFrame([("a",), ("b",)], "order_item_id string")
    looks = FlagIncrements(spark, path, str(tmp_path / "progress"))
    seen = lambda: sorted((r["order_item_id"], r["batch_id"]) for r in looks.read().collect())
    write_batch(rows, path, 0)
    assert seen() == [("a", 0), ("b", 0)]
    assert seen() == []
    write_batch(rows, path, 0)  # a late retry of a batch that was read
    write_batch(rows.limit(1), path, 1)
    assert seen() == [("a", 1)]
    rows.limit(1).selectExpr("*", "0L AS batch_id", "0 AS part").write.mode("overwrite").partitionBy("part").parquet(path)
    looks = FlagIncrements(spark, path, str(tmp_path / "progress"))  # another process, the table started anew
    assert seen() == [("a", 0)]
    assert seen() == []


def test_malformed_log_lines_are_skipped(spark, tmp_path):
    good = '{"timestamp":"2024-01-01T00:00:00.000Z","order_id":"1","row_index":0,"features":{"stock_after_order":1.0}}'
    (tmp_path / "log.json").write_text(good + "\n{broken\n" + good + "\n")
    assert read_feature_log(spark, str(tmp_path)).count() == 2


def test_manifest_missing_or_broken(spark, tmp_path):
    assert load_manifest(spark, str(tmp_path / "none")) is None
    broken = tmp_path / "m" / "manifest" / "00000001-a"
    broken.mkdir(parents=True)
    (broken / "part.txt").write_text("{oops\n")
    assert load_manifest(spark, str(tmp_path / "m")) is None  # not whole: not seen, no warning
    (broken / "_SUCCESS").write_text("")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert load_manifest(spark, str(tmp_path / "m")) is None
    assert any("cannot be read" in str(w.message) for w in seen)
