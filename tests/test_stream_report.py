from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import equal_rows
from pyspark.sql import functions as F
from test_features import small_orders

from orderlens.functions.exprs import hash60
from orderlens.operators import eda, parity, report
from orderlens.operators.features import FEATURES
from orderlens.operators.inventory import offline_reference
from orderlens.operators.scaling import apply_scaler, fit_scaler
from orderlens.operators.scoring import norm_score
from orderlens.session import materialise
from orderlens.sources.stream import envelope, read_files
from orderlens.sources.tables import read_feature_log, read_flags
from orderlens.streaming import state
from orderlens.streaming.job import STATE_STORE, ScoringConfig, start_scoring
from orderlens.streaming.replay import replay_features
from orderlens.streaming.seed import inventory_tail, price_tail, seed_tables, without_ids
from orderlens.streaming.state import live_features

CUT = "2000-06-01"


@pytest.fixture(scope="module")
def case(spark, orders):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    replay = materialise(orders.filter(F.col("order_date") >= CUT), "replay")
    seeds = seed_tables(orders, replay)
    reference = materialise(offline_reference(orders), "reference")
    return replay, seeds, reference


def test_tails_leave_out_replayed_orders(orders, case):
    replay, (_, prices, inventory), _ = case
    history = without_ids(orders, replay)
    assert prices.select(F.max(F.size("prices"))).first()[0] <= 30
    last = history.filter("supplier = 'ASIA' AND category_name = 'PROMO'").orderBy(
        F.desc("order_date"), F.desc("order_id"), F.desc("order_item_id")
    ).limit(30).toPandas()["price"].tolist()[::-1]
    assert prices.filter("supplier = 'ASIA' AND category_name = 'PROMO'").first()["prices"] == last
    assert inventory.count() == orders.select("product_id", "order_region").distinct().count()
    equal = inventory.exceptAll(inventory_tail(orders, replay, max_rows=100).select(inventory.columns))
    assert equal.count() == 0
    assert price_tail(orders, replay).exceptAll(prices).count() == 0


def test_replay_equals_batch(case):
    replay, seeds, reference = case
    live = materialise(replay_features(replay, *seeds), "live")
    table = parity.parity_table(live, reference)
    assert parity.parity_result(table).first()["verdict"] == "PASS"
    assert {r["verdict"] for r in parity.parity_summary(table).collect()} == {"PASS"}
    assert parity.parity_divergence(table).count() == 0
    equal_rows(replay_features(replay, *seeds, max_rows=40), live, FEATURES)


def test_stream_equals_batch(spark, case, tmp_path):
    """Files in date order, several micro-batches, keyed state seeded from history."""
    replay, seeds, reference = case
    numbered = replay.withColumn("row_index", F.col("order_id"))
    ends = ["2000-10-01", "2001-02-01", "2100-01-01"]
    start = CUT
    for i, end in enumerate(ends):
        part = numbered.filter((F.col("order_date") >= start) & (F.col("order_date") < end))
        lines = [r["value"] for r in envelope(part, "row_index").collect()]
        source = tmp_path / "in"
        source.mkdir(exist_ok=True)
        (source / f"{i}.json").write_text("\n".join(lines) + "\n")
        import os

        os.utime(source / f"{i}.json", (1_700_000_000 + i * 60,) * 2)
        start = end
    scaler = fit_scaler(reference)
    config = ScoringConfig(scaler, None, str(tmp_path / "out"), threshold=3.0)
    query = start_scoring(
        read_files(spark, str(tmp_path / "in")), seeds, config, str(tmp_path / "check"), available_now=True
    )
    query.awaitTermination()
    assert query.exception() is None
    log = read_feature_log(spark, str(tmp_path / "out" / "features"))
    assert log.count() == replay.count()
    live = log.select("order_item_id", "features.*")
    expected = reference.join(replay.select("order_item_id"), "order_item_id")
    assert parity.parity_result(parity.parity_table(live, expected)).first()["verdict"] == "PASS"
    flags = read_flags(spark, str(tmp_path / "out" / "flags"))
    scored = norm_score(apply_scaler(expected, scaler))
    assert flags.count() == scored.filter("score >= 3.0").count() > 0
    runs = spark.read.parquet(str(tmp_path / "out" / "runs"))
    assert runs.agg(F.sum("orders_processed")).first()[0] == replay.count()
    assert {r["threshold_source"] for r in runs.collect()} == {"env"}
    assert report.flags_after(flags, 1).count() == flags.filter("batch_id > 1").count()
    assert report.flags_after(flags, 99).count() == flags.count()


def test_keyed_state_edge_cases(spark):
    history = small_orders(spark, [{"order_date": "2024-01-01", "price": 10.0, "quantity": 2.0, "days_real": 3.0, "days_scheduled": 1.0, "discount_rate": 0.1}])
    late = [
        {"order_id": 10, "order_item_id": "10", "order_date": "2024-02-01", "price": 12.0, "quantity": 1.0},
        {"order_id": 11, "order_item_id": "11", "order_date": "2024-02-02", "price": None, "quantity": 3.0},
        {"order_id": 12, "order_item_id": "12", "order_date": "2024-02-03", "price": 20.0, "quantity": 1.0, "product_id": 99},
        {"order_id": 13, "order_item_id": "13", "order_date": "2024-02-04", "price": 5.0, "quantity": 1.0, "category_name": "New"},
    ]
    live = small_orders(spark, late)
    seeds = seed_tables(history)
    for run in (live_features, replay_features):
        got = {r["order_item_id"]: r for r in run(live, *seeds).collect()}
        price = FEATURES[0]
        assert (got["10"][price], got["11"][price], got["12"][price], got["13"][price]) == (2.0, None, 9.0, 0.0)
        # base stock max(1, 1 order x 2 x 2) = 4, new window
        assert (got["10"]["stock_after_order"], got["11"]["stock_after_order"]) == (3.0, 0.0)
        assert got["12"]["stock_after_order"] == -1.0  # unknown pair starts from 0
        assert got["10"]["days_of_cover_remaining"] == 1.5
        assert got["13"]["discount_rate_anomaly"] == 0.0


def test_many_groups_share_a_state_key(spark, case, monkeypatch):
    """Calls are bounded by the buckets; groups of one bucket stay apart, seeds may come in several parts."""
    replay, seeds, _ = case
    monkeypatch.setattr(state, "BUCKETS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = replay.withColumn("product_id", F.when(F.col("order_id") % 50 != 0, F.col("product_id")))
        live = materialise(live_features(rows, *seeds), "bucketed")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(live.columns) == sorted(replay_features(rows, *seeds).columns)
    equal_rows(live.fillna(-1.0, FEATURES), replay_features(rows, *seeds).fillna(-1.0, FEATURES), FEATURES)


def test_last_values_of_several_groups():
    history = np.array([[np.nan, 1.0], [np.nan, np.nan], [2.0, 4.0]])
    at = np.array([0, 0, 0, 2, 2])
    price = np.array([3.0, np.nan, 5.0, 6.0, 8.0])
    last = state._LastValues(history, at, price, np.isfinite(price))
    assert last.fold(np.nanmedian, price).tolist() == [1.0, 2.0, 2.0, 3.0, 5.0]
    assert np.nan_to_num(last.tails(), nan=-1.0).tolist() == [[3.0, 5.0], [-1.0, -1.0], [6.0, 8.0]]


def test_late_order_is_charged_to_the_current_window(spark):
    history = small_orders(spark, [{"order_date": "2024-01-01", "quantity": 2.0}])
    live = small_orders(
        spark,
        [
            {"order_id": 5, "order_item_id": "a", "order_date": "2024-02-01", "quantity": 1.0},
            {"order_id": 6, "order_item_id": "b", "order_date": "2024-01-02", "quantity": 1.0},
        ],
    ).withColumn("arrival", F.col("order_id"))
    got = replay_features(live, *seed_tables(history), order=["arrival", "order_id", "order_item_id"])
    stock = {r["order_item_id"]: r["stock_after_order"] for r in got.collect()}
    assert stock == {"a": 3.0, "b": 2.0}


def test_shuffled_arrival_diverges_but_first_orders_agree(case):
    replay, seeds, reference = case
    arriving = replay.withColumn("arrival", hash60(42, "arrival", "order_item_id"))
    order = ["arrival", "order_id", "order_item_id"]
    live = materialise(replay_features(arriving, *seeds, order=order), "shuffled")
    equal_rows(replay_features(arriving, *seeds, order=order, max_rows=40), live, FEATURES)
    table = parity.parity_table(live, reference)
    assert parity.parity_result(table).first()["verdict"] == "FAIL"
    assert parity.parity_divergence(table).count() >= 1
    a, b = live.withColumn("score", F.col(FEATURES[0])), reference.withColumn("score", F.col(FEATURES[0]))
    flips = parity.verdict_flips(a, b, F.col("score") >= 500).first()
    assert flips["rows"] == replay.count() and 0 < flips["flip_rate"] < 1
    assert parity.flip_examples(a, b, F.col("score") >= 500).count() <= 8


def flags_at(spark, times, reason="delivery_delay_deviation deviated strongly (9.0)"):
    rows = [(t, str(i), 7.0, reason) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "timestamp timestamp, order_id string, anomaly_score double, reason string")


T0 = datetime(2024, 5, 1, 14, 44, 10, 80_000)


@pytest.mark.parametrize(
    ("step", "unit", "buckets", "span"),
    [
        (timedelta(milliseconds=10), "centisecond", 5, "0.0s"),
        (timedelta(seconds=10), "second", 5, "40.0s"),
        (timedelta(minutes=10), "minute", 5, "40m"),
        (timedelta(hours=10), "hour", 5, "1d 16h"),
        (timedelta(hours=5), "hour", 5, "20.0h"),
        (timedelta(days=10), "day", 5, "40d 0h"),
    ],
)
def test_flag_volume_adapts(spark, step, unit, buckets, span):
    flags = flags_at(spark, [T0 + i * step for i in range(5)])
    got = report.flag_volume(flags).collect()
    assert {r["unit"] for r in got} == {unit} and len(got) == buckets
    assert sum(r["count"] for r in got) == 5
    assert report.flag_span(flags).first()["span"] == span


def test_centisecond_label(spark):
    assert report.flag_volume(flags_at(spark, [T0, T0])).first()["bucket"] == "14:44:10.08"


def test_reason_types(spark):
    flags = flags_at(spark, [T0]).unionByName(flags_at(spark, [T0], "something_else (1)")).unionByName(flags_at(spark, [T0], None))
    got = report.display_rows(flags).collect()
    assert [(r["type"], r["severity"]) for r in got] == [("delivery", "Medium"), ("other", "Medium"), ("other", "Medium")]
    assert report.of_types(report.display_rows(flags)).count() == 1
    assert report.of_types(report.display_rows(flags), ["other"]).count() == 2
    assert [r["count"] for r in report.type_counts(flags).collect()] == [2, 1]


def test_kpis_and_freshness(spark):
    row = report.kpis(1000, 85, spark).first()
    assert row["delta_points"] == pytest.approx(2.0) and row["band"] == "off"
    assert report.kpis(0, 0, spark).first()["flag_rate"] == 0
    flags = flags_at(spark, [T0])
    fresh = report.freshness(flags, flags.limit(0), T0 + timedelta(seconds=61)).first()
    assert fresh["status"] == "Idle" and fresh["age_seconds"] == pytest.approx(61)


def test_shown_metrics_fall_back(spark):
    measured = spark.createDataFrame([("precision", 0.28850), ("threshold", 4.53682)], "metric string, value double")
    got = {r["metric"]: r for r in report.shown_metrics(measured, spark).collect()}
    assert got["precision"]["value"] == 0.289 and got["threshold"]["value"] == 4.53682
    assert got["recall"]["value"] == 0.366 and not got["recall"]["measured"]


def test_eda(spark, orders):
    assert eda.shape(orders) == (orders.count(), 13)
    bins = eda.histogram(orders, "quantity").collect()
    assert len(bins) == 25 and sum(r["count"] for r in bins) == orders.count()
    assert eda.null_counts(orders).filter("nulls > 0").count() == 0
    assert eda.column_types(orders).count() == 13
    top = eda.top_values(orders, "category_name", 3).collect()
    assert [r["count"] for r in top] == sorted((r["count"] for r in top), reverse=True)
