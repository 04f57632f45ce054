import numpy as np
import pytest
from conftest import equal_rows
from pyspark.sql import functions as F

from orderlens.functions.exprs import hash60
from orderlens.operators import evaluate as ev
from orderlens.operators.features import FEATURES, PRICE_FEATURE
from orderlens.operators.iforest import average_path, fit_forest, score_forest, tree_samples
from orderlens.operators.knn import build_tree
from orderlens.operators.inventory import inventory_balance
from orderlens.operators.labels import (
    ANOMALY_TYPES,
    STOCK_COLUMNS,
    anomaly_summary,
    label_check,
    label_subsets,
    labelled_orders,
)
from orderlens.operators.lof import fit_lof, score_lof
from orderlens.operators.sampling import (
    block_places,
    block_shuffle,
    disjoint_subsets,
    exact_sample,
    replay_order,
    running_total_by_hash,
)
from orderlens.operators.scaling import (
    SCALED,
    apply_scaler,
    balanced_test,
    feature_medians,
    fit_scaler,
    impute,
    price_scale,
    train_rows,
    with_split,
)
from orderlens.operators.scoring import flag_rows, norm_score, reason_text, resolve_threshold
from orderlens.session import materialise
from orderlens.sources.tables import load_model, save_model


@pytest.fixture(scope="module")
def labelled(orders):
    return materialise(labelled_orders(orders), "labelled")


@pytest.fixture(scope="module")
def scaled(labelled):
    split = with_split(labelled)
    train = train_rows(split)
    scaler = fit_scaler(impute(train, feature_medians(train)))
    return scaler, materialise(norm_score(apply_scaler(split, scaler)), "scaled")


def test_subsets_are_disjoint_and_exact(orders):
    n = orders.count()
    got = {r["subset"]: r["count"] for r in label_subsets(orders).groupBy("subset").count().collect()}
    m = max(1, round(0.015 * n))
    assert got == {0: m, 1: m, 2: m, None: n - 3 * m}


def test_subsets_do_not_depend_on_partitioning(orders):
    a = label_subsets(orders.repartition(37)).select("order_item_id", "subset")
    assert a.exceptAll(label_subsets(orders.coalesce(1)).select("order_item_id", "subset")).count() == 0


def test_subset_is_a_rank_cut(orders):
    h = {r[0]: (r[1], r[0]) for r in orders.select("order_item_id", hash60(42, "s", "order_item_id")).collect()}
    got = disjoint_subsets(orders, [10, 5], "s", "order_item_id", "g").filter("g IS NOT NULL").collect()
    ranked = sorted(h, key=h.get)
    assert {r["order_item_id"] for r in got if r["g"] == 0} == set(ranked[:10])
    assert {r["order_item_id"] for r in got if r["g"] == 1} == set(ranked[10:15])


def test_labels_and_counts(orders, labelled):
    counts = {r["anomaly_type"]: r for r in anomaly_summary(labelled).collect()}
    assert set(counts) == {"normal", *ANOMALY_TYPES}
    assert sum(r["percent"] for r in counts.values()) == pytest.approx(100)
    assert all(r["overlapping"] == 0 for r in label_check(labelled).collect())
    assert labelled.count() == orders.count() + counts["inventory_depletion"]["count"]
    assert labelled.select("order_item_id").distinct().count() == labelled.count()


def test_injected_values_stay_in_range(orders, labelled):
    clean = orders.select("order_item_id", F.col("price").alias("p"), F.col("days_real").alias("d"))
    both = labelled.join(clean, "order_item_id").toPandas()
    spike = both[both.anomaly_type == "price_spike"]
    ratio = spike["price"] / spike["p"]
    assert ratio.between(1.25, 1.5).all()
    delay = both[both.anomaly_type == "delivery_delay"]
    assert (delay["days_real"] - delay["d"]).isin(range(10, 16)).all()
    normal = both[both.anomaly_type == "normal"]
    assert (normal["price"] == normal["p"]).all() and (normal["days_real"] == normal["d"]).all()


def test_bursts_use_new_ids_and_known_windows(orders, labelled):
    burst = labelled.filter("anomaly_type = 'inventory_depletion'").toPandas()
    top = orders.agg(F.max("order_id")).first()[0]
    assert sorted(burst["order_id"]) == list(range(top + 1, top + 1 + len(burst)))
    assert (burst["quantity"] >= 1).all() and (burst["price"] >= 0).all()
    assert (burst["order_date"].dt.second == 0).all()


def test_skewed_labels_equal_uncut(skewed):
    columns = [*FEATURES, "stock_decline_rate", "is_anomaly"]
    equal_rows(labelled_orders(skewed, max_rows=80), labelled_orders(skewed), columns)


def test_running_total_by_hash(orders):
    df = orders.select("order_item_id", (F.col("order_id") % 3 + 1).alias("w"))
    h = hash60(1, "t", "order_item_id")
    rows = running_total_by_hash(df, h, ["order_item_id"], "w", "before").withColumn("h", h).toPandas()
    rows = rows.sort_values(["h", "order_item_id"])
    assert (rows["before"] == rows["w"].cumsum() - rows["w"]).all()


def test_exact_sample_and_replay(orders):
    assert exact_sample(orders, 123, "x", "order_item_id").count() == 123
    assert exact_sample(orders, 10**9, "x", "order_item_id").count() == orders.count()
    days = [r["order_date"] for r in replay_order(orders, 0, 50).collect()]
    assert len(days) == 50 and days == sorted(days)
    blocks = [r["block"] for r in block_shuffle(orders, 7).collect()]
    assert blocks == sorted(blocks)


@pytest.mark.parametrize("part_rows", [5, 100_000])
def test_block_places_follow_the_shuffle(orders, part_rows):
    want = block_shuffle(orders, 30).select("order_item_id", "block").toPandas()
    want["place"] = want.groupby("block").cumcount() + 1
    got = block_places(orders, 30, part_rows=part_rows).select("order_item_id", "block", "place").toPandas()
    by = ["block", "place"]
    assert want.sort_values(by).values.tolist() == got.sort_values(by).values.tolist()


def test_price_scale_chain(spark):
    def scale(values):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        return price_scale(df, float(np.median(values)), "x")[0]

    assert scale([1, 2, 4]) == pytest.approx(1.4826)
    assert scale([0, 0, 0, 0, 0, 3, 5]) == pytest.approx(1.4826)
    assert scale([0, 0, 0, 0, 0, 5]) == pytest.approx(np.std([0, 0, 0, 0, 0, 5]))
    assert scale([7, 7, 7]) == 1.0


def test_scaler_moments(scaled):
    scaler, rows = scaled
    train = rows.filter("split = 'train'").toPandas()
    for f in FEATURES[1:]:
        assert train[f"scaled_{f}"].mean() == pytest.approx(0, abs=1e-9)
        assert train[f"scaled_{f}"].std(ddof=0) == pytest.approx(1)
    assert train[f"scaled_{PRICE_FEATURE}"].median() == pytest.approx(0, abs=1e-9)


def test_serving_fills_zero(spark, scaled):
    scaler, _ = scaled
    df = spark.createDataFrame([(None, float("nan"), float("inf"), 0.0, 0.0)], ", ".join(f"{f} double" for f in FEATURES))
    zero = spark.createDataFrame([(0.0,) * 5], ", ".join(f"{f} double" for f in FEATURES))
    a, b = (apply_scaler(x, scaler).select(*SCALED).first() for x in (df, zero))
    assert a == b


def test_balanced_test_has_equal_halves(labelled):
    got = {r["is_anomaly"]: r["count"] for r in balanced_test(with_split(labelled)).groupBy("is_anomaly").count().collect()}
    assert got[0] == got[1]


def brute_lof(train, query, k, same):
    def nearest(q, drop_self):
        d = np.sqrt(((q[:, None, :] - train[None, :, :]) ** 2).sum(-1))
        if drop_self:
            np.fill_diagonal(d, np.inf)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, 1)

    at, d = nearest(train, True)
    kdist = d[:, -1]
    lrd = 1 / (np.maximum(kdist[at], d).mean(1) + 1e-10)
    lof = lrd[at].mean(1) / lrd
    if same:
        return lof
    qat, qd = nearest(query, False)
    own = 1 / (np.maximum(kdist[qat], qd).mean(1) + 1e-10)
    return lrd[qat].mean(1) / own


@pytest.fixture(scope="module")
def lof_case(spark, scaled):
    _, rows = scaled
    base = materialise(rows.filter("split = 'train'").limit(900).select("order_item_id", *SCALED), "base")
    copies = base.limit(60)
    train = base
    for _ in range(25):
        train = train.unionByName(copies.limit(20))
    train = materialise(train.unionByName(copies), "train")
    return train, fit_lof(train, leaf_rows=64), rows


def test_lof_equals_brute_force_with_copies(lof_case):
    train, model, _ = lof_case
    x = train.select(*SCALED).toPandas().to_numpy()
    lof = brute_lof(x, x, 20, True)
    assert model.threshold == pytest.approx(np.percentile(lof, 93.5))
    fitted = train.join(model.points.select(*SCALED, "lof"), SCALED).select(*SCALED, "lof").toPandas().to_numpy()
    order = lambda m: m[np.lexsort(m.T[::-1])]
    assert np.allclose(order(np.column_stack([x, lof])), order(fitted))


def test_lof_scores_of_new_rows(lof_case):
    train, model, rows = lof_case
    query = materialise(rows.select(*SCALED).limit(400), "query")
    got = score_lof(model, query).select(*SCALED, "score").toPandas().to_numpy()
    assert len(got) == 400
    x = train.select(*SCALED).toPandas().to_numpy()
    assert np.allclose(got[:, 5], brute_lof(x, got[:, :5], 20, False))


def test_knn_with_few_points_and_far_queries(spark):
    train = spark.createDataFrame([(float(i), 0.0) for i in range(8)], "a double, b double")
    model = fit_lof(train, ["a", "b"], k=5, leaf_rows=2)
    query = spark.createDataFrame([(100.0, 3.0), (3.5, 0.0)], "a double, b double")
    got = score_lof(model, query).orderBy("a").toPandas().to_numpy()
    x = np.array([[float(i), 0.0] for i in range(8)])
    assert np.allclose(got[:, 2], brute_lof(x, got[:, :2], 5, False))


def test_lof_does_not_depend_on_partitioning(spark):
    rows = [(float(i % 15), float(i // 15)) for i in range(225)] + [(float(i), -20.0 - i) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double")
    runs = []
    for parts in (1, 7):
        train = df.repartition(parts)
        model = fit_lof(train, ["a", "b"], k=6, leaf_rows=32)
        runs.append((model.threshold, sorted(map(tuple, score_lof(model, train).collect()))))
    assert runs[0] == runs[1]


def test_lof_returns_every_row(spark):
    train = spark.createDataFrame([(float(i), float(i % 3)) for i in range(40)], "a double, b double")
    bad = [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    model = fit_lof(train.union(spark.createDataFrame(bad, "a double, b double")), ["a", "b"], k=5)
    assert model.threshold == fit_lof(train, ["a", "b"], k=5).threshold
    got = score_lof(model, spark.createDataFrame([*bad, (3.0, 0.0), (3.0, 0.0)], "a double, b double")).collect()
    assert len(got) == 5 and sum(r["score"] is None for r in got) == 3


def test_tree_keeps_equal_values_together():
    x = np.zeros((1000, 2))
    x[:700, 1] = np.arange(700)
    tree = build_tree(x, 16)
    leaf = tree.locate(x)
    assert len(set(leaf[700:])) == 1
    assert np.bincount(leaf).max() <= 400


def test_forest_samples_and_scores(spark, scaled):
    _, rows = scaled
    train = materialise(rows.filter("split = 'train'").select("order_item_id", *SCALED), "if_train")
    drawn = tree_samples(train, SCALED, "order_item_id", 12, 256, 42).groupBy("tree").count().collect()
    assert [r["count"] for r in drawn] == [256] * 12
    again = tree_samples(train.repartition(3), SCALED, "order_item_id", 12, 256, 42)
    assert again.exceptAll(tree_samples(train, SCALED, "order_item_id", 12, 256, 42)).count() == 0
    few = tree_samples(train.limit(300), SCALED, "order_item_id", 4, 256, 42).groupBy("tree").count().collect()
    assert [r["count"] for r in few] == [256] * 4
    model = fit_forest(train, trees=50)
    far = train.limit(1).select("order_item_id", *[F.lit(60.0).alias(c) for c in SCALED])
    got = score_forest(model, train.limit(200).unionByName(far)).toPandas()
    assert got["score"].between(0, 1).all()
    assert got["score"].iloc[-1] == got["score"].max()
    share = score_forest(model, train).filter(F.col("score") > model.threshold).count() / train.count()
    assert share == pytest.approx(0.065, abs=0.01)
    assert float(average_path(2)) == 1 and float(average_path(1)) == 0


def test_models_are_saved_with_their_scaler(spark, scaled, lof_case, tmp_path):
    scaler, rows = scaled
    _, lof, _ = lof_case
    save_model(spark, str(tmp_path), lof, scaler, 0.5, 0.065)
    back, same, manifest = load_model(spark, str(tmp_path))
    assert same == scaler and manifest["model_name"] == "lof"
    query = rows.select("order_item_id", *SCALED).limit(50)
    equal_rows(score_lof(back, query), score_lof(lof, query), ["score"])
    forest = fit_forest(rows.select("order_item_id", *SCALED), trees=10)
    save_model(spark, str(tmp_path), forest, scaler, 0.4, 0.065)
    back, _, manifest = load_model(spark, str(tmp_path))
    assert manifest["model_name"] == "isolation_forest" and back.threshold == forest.threshold


def test_threshold_resolution():
    assert resolve_threshold(2.0, {"threshold": 1.0}) == (2.0, "env")
    assert resolve_threshold(None, {"threshold": 1.0}) == (1.0, "manifest")
    assert resolve_threshold(None, {"threshold": "x"}) == (None, "model-predict")
    assert resolve_threshold(None, None) == (None, "model-predict")


def test_reason_ties_keep_feature_order(spark):
    df = spark.createDataFrame([(0.5, -2.0, 2.0, 0.0, 1.0)], ", ".join(f"{c} double" for c in SCALED))
    assert df.select(reason_text()).first()[0] == (
        f"{FEATURES[1]} deviated strongly (2.000); {FEATURES[2]} deviated strongly (2.000); "
        f"{FEATURES[4]} deviated strongly (1.000)"
    )


def test_metrics_by_hand(spark):
    rows = [("1", 1, "price_spike", 9.0), ("2", 1, "price_spike", 1.0), ("3", 0, "normal", 5.0), ("4", 0, "normal", 0.0)]
    df = spark.createDataFrame(rows, "order_item_id string, is_anomaly int, anomaly_type string, score double")
    m = ev.prf(df, F.col("score") >= 4).first()
    assert (m["precision"], m["recall"], m["f1"], m["fp_rate"], m["flag_rate"]) == (0.5, 0.5, 0.5, 0.5, 0.5)
    none = ev.prf(df, F.lit(False)).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    cells = {(r["actual"], r["predicted"]): r["rows"] for r in ev.confusion(df, F.col("score") >= 4).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    recalls = {r["anomaly_type"]: r["recall"] for r in ev.recall_by_type(df, F.col("score") >= 4).collect()}
    assert recalls == {"price_spike": 0.5, "delivery_delay": 0.0, "inventory_depletion": 0.0}
    unlabelled = ev.with_labels(df.select("order_item_id", "score"), df.limit(0))
    assert unlabelled.filter("is_anomaly = 0 AND anomaly_type = 'normal'").count() == 4


def test_comparison_and_best_model(spark):
    rows = [
        {"model": m, "scaling": s, "precision": 0.1234567, "recall": 0.5, "f1": f}
        for m, f in (("lof", 0.7), ("isolation_forest", 0.3))
        for s in ("raw", "standard", "mad_price")
    ]
    metrics = ev.metric_table(spark, rows)
    table = {r["model"]: r for r in ev.comparison_table(metrics).collect()}
    assert table["lof"]["mad_price_f1"] == 0.7 and table["lof"]["raw_precision"] == 0.123457
    assert ev.best_model(metrics) == "lof"


def test_flag_fallback_uses_the_native_threshold(scaled):
    _, rows = scaled
    assert flag_rows(rows, None, 3.0).filter("flagged").count() == rows.filter("score > 3.0").count()


def test_suite_table_equals_each_run_alone(spark):
    """One aggregation over all runs gives what prf and recall_by_type give for each; absent families and runs without flags are 0."""
    rows = [
        (run, int(kind != "normal"), kind, (i * 7 + len(run)) % 3 == 0 and run != "c")
        for run in ("a", "bb", "c")
        for i, kind in enumerate(["normal", "price_spike", "delivery_delay", "normal", "price_spike"] * 5)
    ]
    runs = spark.createDataFrame(rows, "run string, is_anomaly int, anomaly_type string, flagged boolean")
    got = {r.run: r.asDict() for r in ev.suite_table(runs, F.col("flagged"), ["run"]).collect()}
    assert set(got) == {"a", "bb", "c"}
    for run, row in got.items():
        alone = runs.filter(F.col("run") == run)
        for name, value in ev.prf(alone, F.col("flagged")).first().asDict().items():
            assert row[name] == value
        for r in ev.recall_by_type(alone, F.col("flagged")).collect():
            assert row[f"recall_{r.anomaly_type}"] == r.recall
    assert got["a"]["recall_inventory_depletion"] == 0 and got["c"]["f1"] == 0
    assert ev.suite_table(runs.limit(0), F.col("flagged"), ["run"]).count() == 0


def test_labelled_rows_need_no_window_and_keep_the_stock_of_the_whole_table(skewed):
    """Pairs without bursts take their stock over; it is that of the labelled table computed as a whole."""
    got = labelled_orders(skewed)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = materialise(got, "labelled")
    whole = inventory_balance(got.drop(*STOCK_COLUMNS), keep_unkeyed=True).na.fill(0.0, subset=STOCK_COLUMNS)
    assert got.filter("anomaly_type = 'inventory_depletion'").count() > 0
    equal_rows(got, whole, STOCK_COLUMNS)


def test_training_scores_are_matched_without_a_shuffle(spark):
    from orderlens.operators.evaluate import calibrated_threshold, true_rate
    from orderlens.plans import queries

    sf = "/root/testdata/sf0.001"
    labelled, clean = queries.labelled_table(spark, sf), queries.clean_scored_table(spark, sf)
    train = train_rows(labelled)
    by_id = clean.drop("split", "is_anomaly", "anomaly_type").join(train.select("order_item_id"), "order_item_id", "left_semi")
    by_split = train_rows(clean)
    shown = ["order_item_id", "score"]
    assert by_id.count() > 0
    assert by_id.select(shown).exceptAll(by_split.select(shown)).count() == 0
    assert by_split.select(shown).exceptAll(by_id.select(shown)).count() == 0
    rate = true_rate(labelled)
    assert calibrated_threshold(clean, train, rate) == calibrated_threshold(clean.drop("split"), train, rate)
    assert "Exchange" not in by_split._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_forest_paths_equal_a_walk_row_by_row():
    """Ranks and masks in place of values and lookups: every row ends in the leaf that its own values lead to."""
    import pandas as pd

    from orderlens.operators.iforest import Forest, grow_tree

    rng = np.random.default_rng(11)
    rows = np.round(rng.standard_normal((3000, 5)) * [1, 5, 0.1, 30, 2], 2)
    rows[::7, 1], rows[5, 0], rows[6, 2], rows[7, 3] = 0.0, np.nan, np.inf, -np.inf
    for sample, steps in ((256, 8), (40, 6), (2, 1)):
        grown = [[(t, *n) for n in grow_tree(np.nan_to_num(rows[t::30][:sample], posinf=9, neginf=-9), t, 3, steps)] for t in range(20)]
        nodes = pd.DataFrame([n for tree in grown for n in tree], columns=["tree", "node", "feature", "cut", "low", "high", "path", "rows"])
        nodes.loc[nodes["feature"] >= 0, "cut"] = nodes["cut"].round(2)  # many values are equal to a cut
        got = Forest(nodes, 5, steps).paths(rows)
        trees = [{n.node: n for n in t.itertuples()} for _, t in nodes.groupby("tree")]
        for x, total in zip(rows[:400].tolist(), got[:400].tolist(), strict=True):
            walked = 0
            for tree in trees:
                at = tree[1]
                while at.feature >= 0:
                    at = tree[at.high if x[at.feature] > at.cut else at.low]
                walked += at.path
            assert walked == total


def test_lof_takes_neighbours_of_training_points_from_the_fit(spark, monkeypatch):
    """Only points that are not in the fit are searched for, and the scores are those of a search for all."""
    from dataclasses import replace

    from orderlens.operators import lof

    rng = np.random.default_rng(4)
    rows = [tuple(v) for v in np.round(rng.standard_normal((300, 2)), 1).tolist()]  # many copies
    train = spark.createDataFrame(rows[:200], "a double, b double")
    model = fit_lof(train, ["a", "b"], k=7, leaf_rows=16)
    asked, search = [], lof.nearest_lists

    def counted(points, queries, *rest):
        asked.append(queries.count())
        return search(points, queries, *rest)

    monkeypatch.setattr(lof, "nearest_lists", counted)
    every = spark.createDataFrame(rows, "a double, b double")
    got = sorted(map(tuple, score_lof(model, every).collect()))
    searched = sorted(map(tuple, score_lof(replace(model, lists=None), every).collect()))
    assert np.allclose(got, searched)
    assert asked == [len(set(rows) - set(rows[:200])), len(set(rows))]
