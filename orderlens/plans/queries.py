"""Registered queries: every operator over whole tables.

``(spark, sf_dir) -> DataFrame``. Inputs several queries need (the order table,
the labelled table, its scored form) are written once per application to the
shared folder, like the tables of a real deployment, and read from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions.exprs import hash60
from orderlens.operators import eda, evaluate as ev, parity, report
from orderlens.operators import labels as lab
from orderlens.operators.features import (
    CATEGORY,
    FEATURES,
    PRICE_FEATURE,
    delivery_delay,
    delivery_zscore,
    discount_zscore,
    feature_table,
    price_baseline,
    price_deviation,
    quantity_zscore,
    robust_zscore,
)
from orderlens.operators.iforest import fit_forest, score_forest
from orderlens.operators.inventory import (
    inventory_balance,
    offline_reference,
    pair_constants,
    with_restock_window,
)
from orderlens.operators.lof import fit_lof, score_lof, training_scores
from orderlens.operators.quantiles import percentile_values
from orderlens.operators.sampling import SEED, block_places
from orderlens.operators.scaling import (
    SCALED,
    SCALINGS,
    Scaler,
    apply_scaler,
    balanced_test,
    feature_medians,
    fit_scaler,
    impute,
    train_rows,
    with_split,
)
from orderlens.operators.scoring import flag_rows, flagged, norm_score, resolve_threshold
from orderlens.session import materialise, shared_dir
from orderlens.sources.orders import PAIR_KEYS, PRICE_KEYS, RAW_NAMES, dated_orders, read_orders_csv, star_orders, star_table
from orderlens.sources.stream import envelope, open_envelope, read_files
from orderlens.sources.tables import (
    FlagIncrements,
    load_manifest,
    load_model,
    read_feature_log,
    read_flags,
    save_model,
    write_batch,
    write_table,
)
from orderlens.streaming import seed
from orderlens.streaming.job import STATE_STORE, STATE_STORE_SETTING, ScoringConfig, run_record, start_scoring
from orderlens.streaming.replay import replay_features
from orderlens.streaming.state import live_features as keyed_state

ITEM = "order_item_id"
WINDOW_KEYS = lab.WINDOW_KEYS


def r4(c: Column | str) -> Column:
    """Four places, by arithmetic any engine repeats exactly."""
    name = c if isinstance(c, str) else None
    c = F.col(c) if name else c
    out = F.floor(c * 10000 + 0.5) / 10000
    return out.alias(name) if name else out


def rounded(names: list[str]) -> list[Column]:
    return [r4(n) for n in names]


def text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


# --- tables built once per application -------------------------------------------

_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def order_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sparkContext.defaultParallelism
    return _once(spark, sf_dir, "orders", lambda: materialise(star_orders(spark, sf_dir, wanted), "orders"))


def stocked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "stocked",
        lambda: materialise(lab.stocked_orders(order_table(spark, sf_dir)), "stocked"),
    )


def labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of the stocked orders and the pairs with bursts: no row of it needs another one."""
    return _once(
        spark, sf_dir, "labelled",
        lambda: with_split(lab.labelled_orders(order_table(spark, sf_dir), stocked=stocked_table(spark, sf_dir))),
    )


def fitted_scaler(spark: SparkSession, sf_dir: str) -> Scaler:
    def build():
        train = train_rows(labelled_table(spark, sf_dir))
        return fit_scaler(materialise(impute(train, feature_medians(train)).select(*FEATURES), "train_matrix"))

    return _once(spark, sf_dir, "scaler", build)


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return norm_score(apply_scaler(labelled_table(spark, sf_dir), fitted_scaler(spark, sf_dir)))

    return _once(spark, sf_dir, "scored", build)


def clean_scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        scaler, orders = fitted_scaler(spark, sf_dir), order_table(spark, sf_dir)
        if not orders.filter("order_date IS NULL").isEmpty():  # they count in the frozen baseline only
            return materialise(norm_score(apply_scaler(offline_reference(orders), scaler)), "clean_scored")
        features = offline_reference(orders, stocked=stocked_table(spark, sf_dir))
        return with_split(norm_score(apply_scaler(features, scaler)).withColumns(lab.row_labels()))

    return _once(spark, sf_dir, "clean_scored", build)


def calibrated(spark: SparkSession, sf_dir: str) -> float:
    def build():
        labelled = labelled_table(spark, sf_dir)
        clean = clean_scored_table(spark, sf_dir)
        return ev.calibrated_threshold(clean, train_rows(labelled), ev.true_rate(labelled))

    return _once(spark, sf_dir, "calibrated", build)


def native(spark: SparkSession, sf_dir: str) -> float:
    return _once(
        spark, sf_dir, "native",
        lambda: percentile_values(train_rows(scored_table(spark, sf_dir)), {"t": ("score", 0.935)})["t"],
    )


def flagged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged orders as stored; the order date stands in for the time of scoring."""
    scored = flag_rows(scored_table(spark, sf_dir), calibrated(spark, sf_dir))
    return scored.filter("flagged").select(
        ITEM, "order_id", F.col("order_date").alias("timestamp"), F.col("score").alias("anomaly_score"),
        "reason", "is_anomaly", "anomaly_type",
    )


def replay_cut(spark: SparkSession, sf_dir: str):
    """Start of the replay: the last 1,095 days are replayed, all before is history."""
    orders = order_table(spark, sf_dir)
    return _once(
        spark, sf_dir, "cut",
        lambda: orders.agg(F.max("order_date")).first()[0] - timedelta(days=1095),
    )


def history_and_replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, cut = order_table(spark, sf_dir), replay_cut(spark, sf_dir)
    return orders, orders.filter(F.col("order_date") >= F.lit(cut))


def replay_seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, replay = history_and_replay(spark, sf_dir)
    return seed.seed_tables(orders, replay)


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table with unknown values: every 11th order without price, every 13th without quantity, ..."""

    def gap(name: str, every: int) -> Column:
        return F.when(F.col("order_id") % every != 0, F.col(name))

    def build():
        gaps = {"price": 11, "quantity": 13, "days_real": 17, "discount_rate": 19}
        orders = order_table(spark, sf_dir)
        return materialise(orders.withColumns({n: gap(n, k) for n, k in gaps.items()}), "orders_with_gaps")

    return _once(spark, sf_dir, "orders_with_gaps", build)


def keyed_table(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """The replayed orders through the keyed state of the live job, seeded from all that came before."""

    def build():
        orders = orders_with_gaps(spark, sf_dir) if gaps else order_table(spark, sf_dir)
        replay = orders.filter(F.col("order_date") >= F.lit(replay_cut(spark, sf_dir)))
        spark.conf.set(STATE_STORE_SETTING, STATE_STORE)
        return materialise(keyed_state(replay, *seed.seed_tables(orders, replay)), "keyed")

    return _once(spark, sf_dir, f"keyed{gaps}", build)


def evaluation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled stream through the live path, seeded from clean history."""

    def build():
        orders, labelled = order_table(spark, sf_dir), labelled_table(spark, sf_dir)
        seeds = seed.seed_tables(orders, seed.shared_ids(labelled, orders))
        raw = labelled.select(*[c for c in orders.columns])
        return materialise(replay_features(raw, *seeds), "replayed")

    return _once(spark, sf_dir, "replayed", build)


# --- queries -----------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def order_items(spark, sf):
    o = star_orders(spark, sf)
    doubles = ["price", "quantity", "days_real", "days_scheduled", "discount", "discount_rate"]
    return o.select("order_id", ITEM, "product_id", "order_region", "category_name", *rounded(doubles), text("order_date"))


def _orders_query(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: run(order_table(spark, sf))


_orders_query("price_baseline", lambda o: price_baseline(o).select(ITEM, r4("price_baseline")))
_orders_query("price_deviation", lambda o: price_deviation(o).select(ITEM, r4(PRICE_FEATURE)))
_orders_query("quantity_zscore", lambda o: quantity_zscore(o).select(ITEM, r4("order_quantity_zscore_by_category")))
_orders_query("delivery_delay", lambda o: delivery_delay(o).select(ITEM, "delivery_delay_days"))
_orders_query("delivery_zscore", lambda o: delivery_zscore(o).select(ITEM, r4("delivery_delay_deviation")))
_orders_query("discount_zscore", lambda o: discount_zscore(o).select(ITEM, r4("discount_rate_anomaly")))
_orders_query("robust_zscore", lambda o: robust_zscore(o, CATEGORY, "price", "robust_z").select(ITEM, r4("robust_z")))
_orders_query(
    "feature_table",
    lambda o: feature_table(o).select(
        ITEM,
        *rounded(
            [
                PRICE_FEATURE,
                "order_quantity_zscore_by_category",
                "delivery_delay_days",
                "delivery_delay_deviation",
                "discount_rate_anomaly",
            ]
        ),
    ),
)
_orders_query(
    "pair_constants", lambda o: pair_constants(o).select(*PAIR_KEYS, text("first_order_date"), r4("base_stock"))
)
_orders_query("restock_window", lambda o: with_restock_window(o).select(ITEM, "restock_window"))
_orders_query(
    "inventory_balance", lambda o: inventory_balance(o).select(ITEM, *rounded(["base_stock", "stock_after_order"]))
)
_orders_query("recent_demand", lambda o: inventory_balance(o).select(ITEM, r4("recent_demand")))
_orders_query("days_of_cover", lambda o: inventory_balance(o).select(ITEM, r4("days_of_cover_remaining")))
_orders_query("stock_decline", lambda o: inventory_balance(o).select(ITEM, r4("stock_decline_rate")))
_orders_query("offline_reference", lambda o: offline_reference(o).select(ITEM, *rounded(FEATURES)))
_orders_query("label_subsets", lambda o: lab.label_subsets(o).filter("subset IS NOT NULL").select(ITEM, "subset"))
_orders_query(
    "price_spikes",
    lambda o: lab.inject_rows(lab.label_subsets(o)).filter("subset = 0").select(ITEM, r4("price")),
)
_orders_query(
    "delivery_delays",
    lambda o: lab.inject_rows(lab.label_subsets(o)).filter("subset = 1").select(ITEM, r4("days_real")),
)


def _changed(o: DataFrame) -> DataFrame:
    return materialise(with_restock_window(lab.changed_orders(o), keep_unkeyed=True), "changed")


def _window_stats(o: DataFrame) -> DataFrame:
    changed = _changed(o)
    seeds = changed.filter("subset = 2").select(*WINDOW_KEYS).distinct()
    stats = lab.window_stats(changed.join(seeds, WINDOW_KEYS, "left_semi"))
    doubles = [
        f"{f}_{c}" for c, fs in {
            "quantity": ["min", "max", "mean", "median"],
            "price": ["min", "max", "median"],
            "discount": ["min", "max"],
            "rate": ["min", "max"],
        }.items() for f in fs
    ]
    return stats.select(*WINDOW_KEYS, "orders", *rounded(doubles))


_orders_query("window_stats", _window_stats)
_orders_query(
    "burst_rows",
    lambda o: lab.burst_rows(_changed(o)).select(
        "order_id", ITEM, *PAIR_KEYS,
        *rounded(["price", "quantity", "days_real", "discount", "discount_rate", "baseline"]), text("order_date"),
    ),
)
LABELLED_DOUBLES = [
    "price", "quantity", "days_real", "discount", "discount_rate", "order_quantity_zscore_by_category",
    "delivery_delay_days", "delivery_delay_deviation", "discount_rate_anomaly", PRICE_FEATURE,
    *lab.STOCK_COLUMNS,
]


@query
def labelled_orders(spark, sf):
    return labelled_table(spark, sf).select(
        "order_id", ITEM, *PAIR_KEYS, *rounded(LABELLED_DOUBLES), text("order_date"), "is_anomaly", "anomaly_type"
    )


@query
def anomaly_summary(spark, sf):
    return lab.anomaly_summary(labelled_table(spark, sf)).select("anomaly_type", "count", r4("percent"))


@query
def label_check(spark, sf):
    return lab.label_check(labelled_table(spark, sf))


_orders_query(
    "frozen_stats",
    lambda o: seed.frozen_stats(o).select(
        "category_name", *rounded(["delay_mean", "delay_std", "discount_mean", "discount_std"])
    ),
)


def _joined(values: str, places: int) -> Column:
    shown = F.transform(values, lambda v: F.format_string(f"%.{places}f", F.floor(v * 10000 + 0.5) / 10000))
    return F.concat_ws(" ", shown).alias(values)


@query
def price_tail(spark, sf):
    orders, replay = history_and_replay(spark, sf)
    return seed.price_tail(orders, replay.select(ITEM)).select(*PRICE_KEYS, _joined("prices", 4))


@query
def inventory_tail(spark, sf):
    orders, replay = history_and_replay(spark, sf)
    return seed.inventory_tail(orders, replay.select(ITEM)).select(
        *PAIR_KEYS, r4("base_stock"), "last_window", r4("used"), _joined("quantities", 1)
    )


@query
def live_features(spark, sf):
    _, replay = history_and_replay(spark, sf)
    return replay_features(replay, *replay_seeds(spark, sf)).select(ITEM, *rounded(FEATURES))


@query
def train_split(spark, sf):
    return with_split(labelled_table(spark, sf).drop("split")).select(ITEM, "split")


@query
def median_impute(spark, sf):
    values = feature_medians(train_rows(labelled_table(spark, sf)))
    return spark.range(1).select(*[r4(F.lit(values[f])).alias(f) for f in FEATURES])


@query
def price_scale(spark, sf):
    train = train_rows(labelled_table(spark, sf))
    s = fit_scaler(impute(train, feature_medians(train)))
    return spark.range(1).select(
        *[r4(F.lit(v)).alias(n) for n, v in s.as_dict().items() if n.startswith("price_")]
    )


@query
def scaled_features(spark, sf):
    scaled = apply_scaler(labelled_table(spark, sf), fitted_scaler(spark, sf))
    return norm_score(scaled).select(ITEM, *rounded([*SCALED, "score"]))


@query
def flags(spark, sf):
    return flagged_table(spark, sf).select(ITEM, "order_id", r4("anomaly_score"))


@query
def reason_text(spark, sf):
    return flagged_table(spark, sf).select(ITEM, "reason")


RATES = ["flag_rate", "precision", "recall", "f1", "fp_rate"]


def _at(threshold: float) -> Column:
    return F.col("score") >= F.lit(threshold)


@query
def prf(spark, sf):
    out = ev.prf(scored_table(spark, sf), _at(calibrated(spark, sf)))
    return out.select("n", "tp", "fp", "fn", "tn", *rounded(RATES))


@query
def confusion(spark, sf):
    return ev.confusion(scored_table(spark, sf), _at(calibrated(spark, sf)))


@query
def recall_by_type(spark, sf):
    out = ev.recall_by_type(scored_table(spark, sf), _at(calibrated(spark, sf)))
    return out.select("anomaly_type", "true_count", "true_positives", r4("recall"))


@query
def fp_rate(spark, sf):
    out = ev.prf(scored_table(spark, sf), _at(calibrated(spark, sf)))
    return out.select(*rounded(["flag_rate", "fp_rate"]))


@query
def calibrated_threshold(spark, sf):
    labelled, clean = labelled_table(spark, sf), clean_scored_table(spark, sf)
    t = ev.calibrated_threshold(clean, train_rows(labelled), ev.true_rate(labelled))
    return spark.range(1).select(r4(F.lit(t)).alias("threshold"))


@query
def holdouts(spark, sf):
    out = ev.prf(ev.holdouts(scored_table(spark, sf)), _at(native(spark, sf)), ["holdout"])
    return out.select("holdout", "n", *rounded(RATES))


@query
def segment_flag_rates(spark, sf):
    out = ev.segment_flag_rates(scored_table(spark, sf), _at(native(spark, sf)))
    return out.select("segment", r4("flag_rate"))


def _sweep_columns(by: list[str]) -> list:
    return [*by, *rounded(["threshold", *RATES, *[f"recall_{t}" for t in lab.ANOMALY_TYPES]])]


@query
def threshold_sweep(spark, sf):
    out = ev.threshold_sweep(scored_table(spark, sf), [calibrated(spark, sf), *ev.SWEEP])
    return out.select(*_sweep_columns([]))


@query
def before_after(spark, sf):
    rows = ev.holdouts(scored_table(spark, sf))
    out = ev.before_after(rows, native(spark, sf), calibrated(spark, sf), ["holdout"])
    return out.select(*_sweep_columns(["holdout"]))


@query
def score_distribution(spark, sf):
    out = ev.score_distribution(scored_table(spark, sf))
    return out.select("anomaly_type", *rounded(["median", "p95"]), "n")


@query
def median_shift(spark, sf):
    normal = scored_table(spark, sf).filter("is_anomaly = 0")
    out = ev.median_shift(normal, clean_scored_table(spark, sf))
    return out.select(*rounded(["native_median", "clean_median", "shift"]))


@query
def native_space(spark, sf):
    hit = F.count(F.when(_at(calibrated(spark, sf)), 1)).alias("flagged")
    return scored_table(spark, sf).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), hit)


_orders_query(
    "block_shuffle", lambda o: block_places(o, 7).select(ITEM, "block", F.col("place").cast("bigint").alias("place"))
)


@query
def id_anti_join(spark, sf):
    orders, replay = history_and_replay(spark, sf)
    return seed.without_ids(orders, replay).select(ITEM, "quantity")


@query
def id_intersection(spark, sf):
    return seed.shared_ids(labelled_table(spark, sf), order_table(spark, sf))


@query
def training_overlap(spark, sf):
    return parity.against_training(clean_scored_table(spark, sf), labelled_table(spark, sf))


_EVENT = ["order_date", "order_id", ITEM]
_orders_query("earliest_orders", lambda o: o.orderBy(*_EVENT).limit(100).select(ITEM, text("order_date")))
_orders_query(
    "latest_orders",
    lambda o: o.orderBy(*[F.desc(c) for c in _EVENT]).limit(100).select(ITEM, text("order_date")),
)
_orders_query("random_sample", lambda o: eda.sample_rows(o, 500, ITEM).select(ITEM, r4("price")))


@query
def severity(spark, sf):
    level = report.severity(F.col("anomaly_score")).alias("severity")
    return flagged_table(spark, sf).groupBy(level).agg(F.count(F.lit(1)).alias("rows"))


@query
def primary_reason(spark, sf):
    return report.with_reason_type(flagged_table(spark, sf)).select(ITEM, "signal", "type")


@query
def display_rows(spark, sf):
    rows = report.of_types(report.display_rows(flagged_table(spark, sf)))
    return rows.withColumn("score", r4(F.col("score")))


@query
def newest_flags(spark, sf):
    rows = report.newest(flagged_table(spark, sf), 200, ["timestamp", ITEM])
    return rows.select(ITEM, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"))


@query
def flag_volume(spark, sf):
    return report.flag_volume(flagged_table(spark, sf))


@query
def burst_buckets(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    second = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    burst = star_table(spark, sf, "events").select(
        F.timestamp_micros(second + F.pmod(micros, F.lit(1_000_000))).alias("timestamp")
    )
    return report.flag_volume(burst)


@query
def flag_span(spark, sf):
    return report.flag_span(flagged_table(spark, sf))


@query
def kpis(spark, sf):
    out = report.kpis(labelled_table(spark, sf).count(), flagged_table(spark, sf).count(), spark)
    return out.select("processed", "flagged", *rounded(["flag_rate", "delta_points"]), "band")


@query
def type_counts(spark, sf):
    return report.type_counts(flagged_table(spark, sf)).select("type", "count", r4("share"))


def _log(spark, sf):
    return labelled_table(spark, sf).select(F.col("order_date").alias("timestamp"))


@query
def processed_orders(spark, sf):
    return report.processed_orders(_log(spark, sf)).select("processed", text("last_seen"))


@query
def freshness(spark, sf):
    flagged, log = flagged_table(spark, sf), _log(spark, sf)
    now = log.agg(F.max("timestamp")).first()[0] + timedelta(seconds=30)
    return report.freshness(flagged, log, now).select(text("last"), "age_seconds", "status")


@query
def shown_metrics(spark, sf):
    out = ev.prf(scored_table(spark, sf), _at(calibrated(spark, sf)))
    names = ["precision", "recall", "f1"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    shown = report.shown_metrics(out.select(F.inline(pairs)), spark)
    return shown.select("metric", r4("value"), "measured")


_orders_query("coverage", parity.coverage)
_orders_query("null_counts", lambda o: eda.null_counts(o))
_orders_query(
    "histogram", lambda o: eda.histogram(o, "price").select("bin", *rounded(["low", "high"]), "count")
)
_orders_query("top_values", lambda o: eda.top_values(o, "category_name"))


# --- models and parity: no SQL form, checked against brute force in tests ---------------


def imputed_train(spark, sf) -> DataFrame:
    """The training normals, unknown features filled with their medians."""
    train = train_rows(labelled_table(spark, sf))
    return impute(train, feature_medians(train))


def _train_matrix(spark, sf) -> DataFrame:
    def build():
        scaled = apply_scaler(imputed_train(spark, sf), fitted_scaler(spark, sf))
        return materialise(scaled.select(ITEM, *SCALED), "train_scaled")

    return _once(spark, sf, "train_scaled", build)


@query
def lof_scores(spark, sf):
    """LOF of all labelled orders among the training normals."""
    model = fit_lof(_train_matrix(spark, sf))
    rows = scored_table(spark, sf).drop("score")
    out = score_lof(model, rows)
    return out.select(ITEM, "anomaly_type", "score", (F.col("score") > model.threshold).alias("flagged"))


FULL_SWEEP = [0.45, 0.5, 0.55]


def fitted_forest(spark, sf):
    return _once(spark, sf, "forest", lambda: fit_forest(_train_matrix(spark, sf)))


def forest_scored(spark, sf) -> DataFrame:
    """All labelled orders with the score and the flag of a forest of the training normals."""

    def build():
        model = fitted_forest(spark, sf)
        out = score_forest(model, scored_table(spark, sf).drop("score"))
        out = out.select(ITEM, "is_anomaly", "anomaly_type", "score")
        return materialise(out.withColumn("flagged", F.col("score") > model.threshold), "forest_scored")

    return _once(spark, sf, "forest_scored", build)


@query
def iforest_scores(spark, sf):
    return forest_scored(spark, sf).select(ITEM, "anomaly_type", r4("score"), "flagged")


@query
def full_data_model(spark, sf):
    """The deployed forest, of training normals, against one of all rows: the same sweep for both."""
    rows = scored_table(spark, sf).drop("score")
    models = {"forest": forest_scored(spark, sf), "full": score_forest(fit_forest(rows), rows)}
    swept = [ev.threshold_sweep(scored, FULL_SWEEP).withColumn("model", F.lit(name)) for name, scored in models.items()]
    return swept[0].unionByName(swept[1]).select("model", *_sweep_columns([]))


@query
def forest_metrics(spark, sf):
    """Precision, recall and rates of the forest's own flags."""
    out = ev.prf(forest_scored(spark, sf), F.col("flagged"))
    return out.select("n", "tp", "fp", "fn", "tn", *rounded(RATES))


@query
def forest_recall_by_type(spark, sf):
    out = ev.recall_by_type(forest_scored(spark, sf), F.col("flagged"))
    return out.select("anomaly_type", "true_count", "true_positives", r4("recall"))


@query
def forest_sweep(spark, sf):
    """The forest's scores at fixed thresholds, with recall by type."""
    out = ev.threshold_sweep(forest_scored(spark, sf), [0.4, 0.45, 0.5, 0.55, 0.6])
    return out.select(*_sweep_columns([]))


@query
def model_comparison(spark, sf):
    """Both models under the three scalings on the balanced test."""
    labelled, scaler = labelled_table(spark, sf), fitted_scaler(spark, sf)
    train, test = imputed_train(spark, sf), materialise(balanced_test(labelled), "balanced")
    rows = []
    for scaling in SCALINGS:
        fitted_on = materialise(apply_scaler(train, scaler, scaling).select(ITEM, *SCALED), "fit")
        scored_on = apply_scaler(test, scaler, scaling)
        forest, lof = fit_forest(fitted_on), fit_lof(fitted_on)
        runs = {
            "isolation_forest": (forest, score_forest(forest, scored_on)),
            "lof": (lof, score_lof(lof, scored_on)),
        }
        for name, (model, out) in runs.items():
            m = ev.prf(out, F.col("score") > model.threshold).first().asDict()
            rows.append({"model": name, "scaling": scaling, **m})
    return ev.comparison_table(ev.metric_table(spark, rows))


def suite_runs(spark, sf) -> DataFrame:
    """The balanced test under every run (model, scaling): forests of the three scalings, and the vector length."""

    def build():
        scaler, train = fitted_scaler(spark, sf), imputed_train(spark, sf)
        test = materialise(balanced_test(labelled_table(spark, sf)), "balanced")
        shown = [ITEM, "is_anomaly", "anomaly_type"]
        runs = []
        for scaling in SCALINGS:
            model = fit_forest(apply_scaler(train, scaler, scaling).select(ITEM, *SCALED))
            out = score_forest(model, apply_scaler(test, scaler, scaling).select(*shown, *SCALED))
            runs.append(("isolation_forest", scaling, out.withColumn("flagged", F.col("score") > model.threshold)))
        length = norm_score(apply_scaler(test, scaler))
        runs.append(("vector_length", "mad_price", length.withColumn("flagged", F.col("score") > native(spark, sf))))
        parts = [
            out.select(F.lit(name).alias("model"), F.lit(scaling).alias("scaling"), *shown, "flagged") for name, scaling, out in runs
        ]
        together = parts[0]
        for part in parts[1:]:
            together = together.unionByName(part)
        return materialise(together, "suite_runs")

    return _once(spark, sf, "suite_runs", build)


def suite_metrics(spark, sf) -> DataFrame:
    return ev.suite_table(suite_runs(spark, sf), F.col("flagged"), ["model", "scaling"])


@query
def model_suite(spark, sf):
    """Rates and recall by anomaly type of every run on the balanced test."""
    recalls = [f"recall_{t}" for t in lab.ANOMALY_TYPES]
    return suite_metrics(spark, sf).select("model", "scaling", "n", "tp", "fp", "fn", "tn", *rounded([*RATES, *recalls]))


@query
def best_model(spark, sf):
    """The model with the highest F1 under the scaling that is deployed."""
    metrics = suite_metrics(spark, sf)
    best = ev.best_model(metrics)
    return metrics.filter((F.col("scaling") == "mad_price") & (F.col("model") == best)).select("model", r4("f1"))


@query
def live_scoring(spark, sf):
    """The labelled stream through the live path: scores, flags and reasons."""
    live = apply_scaler(evaluation_stream(spark, sf), fitted_scaler(spark, sf))
    scored = flag_rows(norm_score(live), calibrated(spark, sf))
    out = ev.with_labels(scored.select(ITEM, "score", "flagged", "reason"), labelled_table(spark, sf))
    return out.withColumn("score", r4(F.col("score")))


@query
def live_evaluation(spark, sf):
    out = ev.prf(live_scoring(spark, sf), F.col("flagged"))
    return out.select("n", "tp", "fp", "fn", "tn", *rounded(RATES))


@query
def keyed_features(spark, sf):
    """Live features from the keyed state itself."""
    return keyed_table(spark, sf).select(ITEM, *rounded(FEATURES))


@query
def keyed_features_with_gaps(spark, sf):
    """The same with unknown prices, quantities, days and rates in history and replay."""
    return keyed_table(spark, sf, gaps=True).select(ITEM, *rounded(FEATURES))


@query
def live_features_with_gaps(spark, sf):
    """The finite replay, as windows, over the same unknown values."""
    orders = orders_with_gaps(spark, sf)
    replay = orders.filter(F.col("order_date") >= F.lit(replay_cut(spark, sf)))
    return replay_features(replay, *seed.seed_tables(orders, replay)).select(ITEM, *rounded(FEATURES))


@query
def reference_with_gaps(spark, sf):
    return offline_reference(orders_with_gaps(spark, sf)).select(ITEM, *rounded(FEATURES))


def scored_stream(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a scoring run over the replay: message files in two parts, the job stopped and restarted between them."""

    def build():
        orders, replay = history_and_replay(spark, sf_dir)
        folder = f"{shared_dir(spark)}/scoring-{uuid.uuid4().hex}"
        config = ScoringConfig(fitted_scaler(spark, sf_dir), fitted_forest(spark, sf_dir), f"{folder}/out")
        seeds = replay_seeds(spark, sf_dir)
        later = F.col("order_date") >= F.lit(replay_cut(spark, sf_dir) + timedelta(days=700))
        for part in (replay.filter(~later), replay.filter(later)):
            envelope(part, "order_id").write.mode("append").text(f"{folder}/in")
            arriving = read_files(spark, f"{folder}/in", files_per_trigger=1_000_000)
            start_scoring(arriving, seeds, config, f"{folder}/progress", available_now=True).awaitTermination()
        return folder

    return _once(spark, sf_dir, "scored_stream", build)


@query
def scoring_job(spark, sf):
    """Flags of the streaming job: message files, keyed state, forest, flag table."""
    flags = read_flags(spark, f"{scored_stream(spark, sf)}/out/flags")
    return flags.select(ITEM, "order_id", r4("anomaly_score"))


@query
def scoring_log(spark, sf):
    """The feature log of the same run: every order, flagged or not."""
    log = read_feature_log(spark, f"{scored_stream(spark, sf)}/out/features")
    return log.select(ITEM, "order_id", *[r4(F.col(f"features.{f}")).alias(f) for f in FEATURES])


@query
def scoring_run(spark, sf):
    """The record of the same run."""
    record = run_record(spark, f"{scored_stream(spark, sf)}/out")
    return record.select("model_name", "threshold", "threshold_source", "orders_processed", "batches")


def _parity(spark, sf) -> DataFrame:
    """The keyed state against the batch reference."""
    return parity.parity_table(keyed_table(spark, sf), offline_reference(order_table(spark, sf)))


@query
def parity_with_gaps(spark, sf):
    """Where unknown values part the keyed state from the batch reference, by feature."""
    reference = offline_reference(orders_with_gaps(spark, sf))
    table = parity.parity_table(keyed_table(spark, sf, gaps=True), reference)
    out = parity.parity_summary(table)
    return out.withColumn("max_abs_delta", r4(F.col("max_abs_delta")))


@query
def parity_summary(spark, sf):
    out = parity.parity_summary(_parity(spark, sf))
    return out.withColumn("max_abs_delta", r4(F.col("max_abs_delta")))


@query
def parity_result(spark, sf):
    return parity.parity_result(_parity(spark, sf))


def _shuffled(spark, sf) -> DataFrame:
    """Live features when the replay arrives in random order."""
    _, replay = history_and_replay(spark, sf)
    arriving = replay.withColumn("arrival", hash60(SEED, "arrival", ITEM))
    return replay_features(arriving, *replay_seeds(spark, sf), order=["arrival", "order_id", ITEM])


@query
def parity_divergence(spark, sf):
    table = parity.parity_table(_shuffled(spark, sf), offline_reference(order_table(spark, sf)))
    out = parity.parity_divergence(materialise(table, "parity"))
    return out.select("feature", "diverged", *rounded(["mean_delta", "max_delta", "median_delta"]))


@query
def verdict_flips(spark, sf):
    live = norm_score(apply_scaler(_shuffled(spark, sf), fitted_scaler(spark, sf)))
    out = parity.verdict_flips(live, clean_scored_table(spark, sf), _at(calibrated(spark, sf)))
    return out.withColumn("flip_rate", r4(F.col("flip_rate")))


@query
def stream_envelope(spark, sf):
    """Every order as a JSON message and back."""
    messages = envelope(order_table(spark, sf), "order_id")
    return open_envelope(messages).select(ITEM, "order_id", *PAIR_KEYS, r4("price"), text("order_date"))


# --- sources, sinks and stores, written to the shared folder and read back ----------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_orders(spark, sf):
    """Raw Latin-1 CSV with unreadable prices and dates, read leniently; undated orders are dropped."""
    orders, path = order_table(spark, sf), _folder(spark, "raw")
    cells = {c: F.col(c).cast("string") for c in RAW_NAMES}
    cells["category_name"] = F.concat("category_name", F.lit(" \u00e9, \"x\""))
    cells["price"] = F.when(F.col("order_id") % 11 == 0, F.lit("n/a")).otherwise(cells["price"])
    shown = F.date_format("order_date", "M/d/yyyy HH:mm")
    cells["order_date"] = F.when(F.col("order_id") % 13 == 0, F.lit("soon")).otherwise(shown)
    raw = orders.select(*[cells[c].alias(title) for c, title in RAW_NAMES.items()])
    raw.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    back = dated_orders(read_orders_csv(spark, path))
    return back.select("order_id", ITEM, *PAIR_KEYS, *PRICE_KEYS, *rounded(["price", "quantity", "days_real"]), text("order_date"))


@query
def id_list(spark, sf):
    """The ids of the replay as a stored list; history is what the list leaves."""
    orders, replay = history_and_replay(spark, sf)
    path = _folder(spark, "ids")
    write_table(replay.select(ITEM), path, "csv")
    stored = spark.read.option("header", True).schema(f"{ITEM} string").csv(path)
    return seed.without_ids(orders, stored).select(ITEM)


@query
def labelled_sink(spark, sf):
    """The labelled table as stored in CSV."""
    labelled, path = labelled_table(spark, sf), _folder(spark, "labelled")
    write_table(labelled, path, "csv")
    back = spark.read.option("header", True).schema(labelled.schema).csv(path)
    return back.select("order_id", ITEM, *rounded(LABELLED_DOUBLES), text("order_date"), "is_anomaly", "anomaly_type")


def model_store(spark: SparkSession, sf_dir: str) -> str:
    """Folder with two published versions of the forest, the second one current."""

    def build():
        path, model, scaler = _folder(spark, "models"), fitted_forest(spark, sf_dir), fitted_scaler(spark, sf_dir)
        for f1 in (0.0, 1.0):
            save_model(spark, path, model, scaler, f1, 0.065)
        return path

    return _once(spark, sf_dir, "model_store", build)


@query
def stored_model(spark, sf):
    """Scores of the current version as read back from the store, with its own scaler and threshold."""
    model, scaler, manifest = load_model(spark, model_store(spark, sf))
    out = score_forest(model, apply_scaler(labelled_table(spark, sf), scaler))
    hit = (F.col("score") > manifest["threshold"]).alias("flagged")
    return out.select(ITEM, r4("score"), hit, F.lit(manifest["f1"]).alias("f1"))


@query
def threshold_sources(spark, sf):
    """Flags under a given threshold, the manifest's, and the model's own label."""
    manifest, scored = load_manifest(spark, model_store(spark, sf)), forest_scored(spark, sf)
    own = fitted_forest(spark, sf).threshold
    counts, names = [], []
    for override, known in ((0.5, manifest), (None, manifest), (None, {})):
        threshold, source = resolve_threshold(override, known)
        counts.append(F.count(F.when(flagged(F.col("score"), threshold, own), 1)))
        names.append(source)
    rows = [F.struct(F.lit(n).alias("source"), c.alias("flags")) for n, c in zip(names, counts, strict=True)]
    return scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query
def first_flips(spark, sf):
    live = norm_score(apply_scaler(_shuffled(spark, sf), fitted_scaler(spark, sf)))
    out = parity.flip_examples(live, clean_scored_table(spark, sf), _at(calibrated(spark, sf)))
    return out.select(ITEM, "live", "offline", *rounded(["live_score", "offline_score"]))


@query
def flag_increments(spark, sf):
    """Three looks at a growing flag table: two batches, one more, and the table started anew."""
    flags, path = flagged_table(spark, sf), _folder(spark, "flags")
    part = lambda n: flags.filter(F.col("order_id") % 3 == n)
    looks = FlagIncrements(spark, path, _folder(spark, "looked"))
    write_batch(part(0), path, 0)
    write_batch(part(1), path, 1)
    read = [looks.read()]
    write_batch(part(2), path, 2)
    read.append(looks.read())
    anew = part(0).withColumns({"batch_id": F.lit(0).cast("bigint"), "part": F.lit(0)})
    anew.write.mode("overwrite").partitionBy("part").parquet(path)
    read.append(looks.read())
    rows = [r.select(F.lit(i + 1).alias("look"), ITEM, "batch_id") for i, r in enumerate(read)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


PROFILE = ["price", "quantity", "discount_rate", "days_real", "orders"]


@query
def lof_products(spark, sf):
    """LOF of every product among all products, by its mean order."""
    mean = lambda c, scale: (F.floor(F.avg(c) * scale * 1_000_000 + 0.5) / 1_000_000).alias(c)
    profile = order_table(spark, sf).groupBy("product_id").agg(
        mean("price", 0.01), mean("quantity", 0.1), mean("discount_rate", 100.0), mean("days_real", 0.1),
        F.count(F.lit(1)).cast("double").alias("orders"),
    )
    profile = materialise(profile, "profile")
    return training_scores(fit_lof(profile, PROFILE), profile).select("product_id", r4("score"))
