"""Evaluation and calibration reports over scored, labelled rows.

Input columns: ``order_item_id``, ``is_anomaly``, ``anomaly_type``, ``score``.
Every report is one combinable aggregate; no row is multiplied per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions.exprs import ratio
from orderlens.operators.labels import ANOMALY_TYPES, NORMAL
from orderlens.operators.quantiles import grouped_percentiles, percentile_values
from orderlens.operators.sampling import SEED, exact_sample
from orderlens.operators.scaling import balanced_test, train_rows
from orderlens.session import materialise

SWEEP = [3.0, 4.0, 6.0, 9.0]


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _counts(pred: Column) -> dict[str, Column]:
    y = F.col("is_anomaly") == 1
    return {
        "n": F.count(F.lit(1)),
        "tp": _n(y & pred),
        "fp": _n(~y & pred),
        "fn": _n(y & ~pred),
        "tn": _n(~y & ~pred),
    }


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(precision * recall * 2, precision + recall)
    return {
        "flag_rate": ratio(tp + fp, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "fp_rate": ratio(fp, fp + tn),
    }


def prf(df: DataFrame, pred: Column, by: list[str] = ()) -> DataFrame:
    """Counts, flag rate, precision, recall, F1 and false-positive rate (0 on zero division)."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in _counts(pred).items()])
    return counts.withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def confusion(df: DataFrame, pred: Column) -> DataFrame:
    """2 x 2 confusion matrix in long form; empty cells are 0."""
    counts = df.agg(*[c.alias(n) for n, c in _counts(pred).items()])
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    grid = F.array(
        *[
            F.struct(F.lit(y).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("rows"))
            for y, p, c in cells
        ]
    )
    return counts.select(F.inline(grid))


def recall_by_type(df: DataFrame, pred: Column) -> DataFrame:
    """True positives, total and recall of each anomaly family; 0 for an absent one."""
    counts = df.agg(
        *[_n((F.col("anomaly_type") == t) & (F.col("is_anomaly") == 1)).alias(f"n_{t}") for t in ANOMALY_TYPES],
        *[_n((F.col("anomaly_type") == t) & (F.col("is_anomaly") == 1) & pred).alias(f"tp_{t}") for t in ANOMALY_TYPES],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("anomaly_type"),
                F.col(f"n_{t}").alias("true_count"),
                F.col(f"tp_{t}").alias("true_positives"),
                ratio(F.col(f"tp_{t}"), F.col(f"n_{t}")).alias("recall"),
            )
            for t in ANOMALY_TYPES
        ]
    )
    return counts.select(F.inline(rows))


def true_rate(labelled: DataFrame) -> float:
    return labelled.agg(F.avg("is_anomaly")).first()[0] or 0.0


def calibrated_threshold(
    scores: DataFrame, train_ids: DataFrame, rate: float, max_rows: int | None = None
) -> float:
    """Score percentile at 1 - true rate over the training normals, matched by id.

    Scores that carry the ``split`` of their rows are matched by it: labels and split are
    functions of the id, so equal ids have one split and nothing needs to be shuffled.
    """
    if "split" in scores.columns:
        of_train = train_rows(scores).filter(F.col("order_item_id").isNotNull())
    else:
        of_train = scores.join(train_ids.select("order_item_id"), "order_item_id", "left_semi")
    of_train = materialise(of_train.select("score"), "train_scores")
    return percentile_values(of_train, {"t": ("score", 1.0 - rate)}, max_rows)["t"]


def with_labels(scores: DataFrame, labelled: DataFrame) -> DataFrame:
    """Attach labels by id; a row without a label counts as normal."""
    labels = labelled.select("order_item_id", "is_anomaly", "anomaly_type")
    joined = scores.join(labels, "order_item_id", "left")
    return joined.withColumns(
        {
            "is_anomaly": F.coalesce("is_anomaly", F.lit(0)),
            "anomaly_type": F.coalesce("anomaly_type", F.lit(NORMAL)),
        }
    )


def holdouts(split: DataFrame, seed: int = SEED) -> DataFrame:
    """Three test populations, stacked with a ``holdout`` name: all held normals and
    anomalies; anomalies thinned to their population share; balanced half and half."""
    held = split.filter(F.col("split") == "held")
    anomalies = split.filter(F.col("split") == "anomaly")
    counts = split.agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("split") == "held").alias("held"),
        _n(F.col("split") == "anomaly").alias("anomalies"),
    ).first()
    share = counts["anomalies"] / counts["n"]
    wanted = round(counts["held"] * share / (1 - share)) if share < 1 else counts["anomalies"]
    parts = {
        "all": held.unionByName(anomalies),
        "population": held.unionByName(
            exact_sample(anomalies, wanted, "population", "order_item_id", seed)
        ),
        "balanced": balanced_test(split, seed),
    }
    stacked = None
    for name, part in parts.items():
        part = part.withColumn("holdout", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def segment_flag_rates(split: DataFrame, pred: Column) -> DataFrame:
    """Share flagged among train normals, held normals, anomalies and all rows."""
    segments = ["train", "held", "anomaly"]
    rate = lambda cond: ratio(_n(cond & pred), _n(cond))
    rows = [(s, rate(F.col("split") == s)) for s in segments] + [("all", rate(F.lit(True)))]
    agg = split.agg(*[c.alias(s) for s, c in rows])
    grid = F.array(
        *[F.struct(F.lit(s).alias("segment"), F.col(s).alias("flag_rate")) for s, _ in rows]
    )
    return agg.select(F.inline(grid))


def median_shift(native: DataFrame, clean: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Median score of the same orders in both feature spaces."""
    shared = native.select("order_item_id", F.col("score").alias("native")).join(
        clean.select("order_item_id", F.col("score").alias("clean")), "order_item_id"
    )
    medians = grouped_percentiles(
        shared, [], {"native_median": ("native", 0.5), "clean_median": ("clean", 0.5)}, max_rows
    )
    return medians.withColumn("shift", F.col("clean_median") - F.col("native_median"))


def threshold_sweep(df: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """Rates and recall by type at each threshold, from one pass over the scores."""
    aggs, rows = [], []
    for i, t in enumerate(thresholds):
        pred = F.col("score") >= F.lit(float(t))
        aggs += [c.alias(f"{n}_{i}") for n, c in _counts(pred).items()]
        rates = _rates(*[F.col(f"{c}_{i}") for c in ("tp", "fp", "fn", "tn")])
        recalls = []
        for kind in ANOMALY_TYPES:
            of_kind = (F.col("anomaly_type") == kind) & (F.col("is_anomaly") == 1)
            aggs += [_n(of_kind & pred).alias(f"tp_{kind}_{i}"), _n(of_kind).alias(f"n_{kind}_{i}")]
            recalls.append(
                ratio(F.col(f"tp_{kind}_{i}"), F.col(f"n_{kind}_{i}")).alias(f"recall_{kind}")
            )
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                *[c.alias(n) for n, c in rates.items()],
                *recalls,
            )
        )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def before_after(df: DataFrame, before: float, after: float, by: list[str] = ()) -> DataFrame:
    """The same populations at the current and the recalibrated threshold."""
    return threshold_sweep(df, [before, after], by)


def score_distribution(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Median, 95th percentile and size of the scores of each type."""
    quantiles = grouped_percentiles(
        df, ["anomaly_type"], {"median": ("score", 0.5), "p95": ("score", 0.95)}, max_rows
    )
    sizes = df.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    return quantiles.join(sizes, "anomaly_type")


def metric_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Model comparison in long form: model, scaling, precision, recall, f1 (6 places)."""
    tidy = [
        (r["model"], r["scaling"], *[round(float(r[m]), 6) for m in ("precision", "recall", "f1")])
        for r in rows
    ]
    return spark.createDataFrame(
        tidy, "model string, scaling string, precision double, recall double, f1 double"
    )


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per model, metrics side by side for each scaling."""
    scalings = ["raw", "standard", "mad_price"]
    return metrics.groupBy("model").pivot("scaling", scalings).agg(
        F.max("precision").alias("precision"), F.max("recall").alias("recall"), F.max("f1").alias("f1")
    )


def suite_table(runs: DataFrame, pred: Column, by: list[str]) -> DataFrame:
    """One row per run: what ``prf`` gives and the recall of each anomaly family; one aggregation for all runs."""
    found = lambda t: (F.col("anomaly_type") == t) & (F.col("is_anomaly") == 1)
    counts = _counts(pred)
    for t in ANOMALY_TYPES:
        counts |= {f"_n_{t}": _n(found(t)), f"_tp_{t}": _n(found(t) & pred)}
    out = runs.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
    out = out.withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))
    out = out.withColumns({f"recall_{t}": ratio(F.col(f"_tp_{t}"), F.col(f"_n_{t}")) for t in ANOMALY_TYPES})
    return out.drop(*[f"_{c}_{t}" for t in ANOMALY_TYPES for c in ("n", "tp")])


def best_model(metrics: DataFrame, scaling: str = "mad_price") -> str:
    """Model with the highest F1 under ``scaling``."""
    ranked = metrics.filter(F.col("scaling") == scaling).orderBy(F.desc("f1"), "model")
    return ranked.first()["model"]
