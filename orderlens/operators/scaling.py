"""Train/test split, imputation and scaling. Fit once, apply as column arithmetic."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.functions.exprs import finite, uniform
from orderlens.operators.features import FEATURES, PRICE_FEATURE
from orderlens.operators.quantiles import percentile_values
from orderlens.operators.sampling import SEED, exact_sample

TRAIN_SHARE = 0.70
MAD_TO_SIGMA = 1.4826
SCALINGS = ["raw", "standard", "mad_price"]


def scaled_name(feature: str) -> str:
    return f"scaled_{feature}"


SCALED = [scaled_name(f) for f in FEATURES]


def with_split(labelled: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``split``: normal rows are ``train`` (70 %) or ``held``; the rest ``anomaly``."""
    drawn = F.when(uniform(seed, "split", "order_item_id") < TRAIN_SHARE, "train").otherwise("held")
    return labelled.withColumn("split", F.when(F.col("is_anomaly") == 0, drawn).otherwise("anomaly"))


def train_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split") == "train")


def balanced_test(split: DataFrame, seed: int = SEED) -> DataFrame:
    """All anomalies and as many held-out normals (all of them if there are fewer)."""
    anomalies = split.filter(F.col("split") == "anomaly")
    held = split.filter(F.col("split") == "held")
    return anomalies.unionByName(
        exact_sample(held, anomalies.count(), "balanced", "order_item_id", seed)
    )


def feature_medians(train: DataFrame, max_rows: int | None = None) -> dict[str, float]:
    return percentile_values(train, {f: (f, 0.5) for f in FEATURES}, max_rows)


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Fill missing features with given values (training medians)."""
    return df.withColumns({f: F.coalesce(finite(f), F.lit(v)) for f, v in values.items()})


def price_scale(
    train: DataFrame, median: float, column: str = PRICE_FEATURE, max_rows: int | None = None
) -> tuple[float, float]:
    """(scale, MAD) of a column that may be mostly zeros.

    The scale is 1.4826 MAD; if that is 0, 1.4826 MAD of the nonzero values; if
    that is 0 too, the population standard deviation; and 1.0 as a last resort.
    """

    def mad_of(df: DataFrame, centre: float) -> float:
        off = df.select(F.abs(F.col(column) - F.lit(centre)).alias("off"))
        return percentile_values(off, {"mad": ("off", 0.5)}, max_rows)["mad"] or 0.0

    mad = mad_of(train, median)
    scale = MAD_TO_SIGMA * mad
    if scale == 0:
        nonzero = train.filter(F.col(column) != 0)
        centre = percentile_values(nonzero, {"m": (column, 0.5)}, max_rows)["m"]
        scale = 0.0 if centre is None else MAD_TO_SIGMA * mad_of(nonzero, centre)
    if scale == 0:
        scale = train.agg(F.stddev_pop(column)).first()[0] or 0.0
    return (scale or 1.0), mad


@dataclass(frozen=True)
class Scaler:
    """Fitted scaling: robust for the price deviation, mean/spread for the rest."""

    price_median: float
    price_mad: float
    price_scale: float
    means: dict[str, float]
    stds: dict[str, float]

    def scaled(self, feature: str, value: Column) -> Column:
        if feature == PRICE_FEATURE:
            return (value - F.lit(self.price_median)) / F.lit(self.price_scale or 1.0)
        return (value - F.lit(self.means[feature])) / F.lit(self.stds[feature] or 1.0)

    def as_dict(self) -> dict:
        return asdict(self)


def fit_scaler(train: DataFrame, max_rows: int | None = None) -> Scaler:
    """Fit on imputed training rows: one pass of moments, two of exact percentiles."""
    moments = train.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"std_{f}") for f in FEATURES],
    ).first()
    median = percentile_values(train, {"m": (PRICE_FEATURE, 0.5)}, max_rows)["m"]
    scale, mad = price_scale(train, median, max_rows=max_rows)
    return Scaler(
        median,
        mad,
        scale,
        {f: moments[f"mean_{f}"] for f in FEATURES},
        {f: moments[f"std_{f}"] for f in FEATURES},
    )


def apply_scaler(df: DataFrame, scaler: Scaler, scaling: str = "mad_price") -> DataFrame:
    """Add the scaled features. Missing or infinite features count as 0."""
    if scaling not in SCALINGS:
        raise ValueError(f"scaling is one of {SCALINGS}")

    def value(f: str) -> Column:
        x = F.coalesce(finite(f), F.lit(0.0))
        if scaling == "raw":
            return x
        if scaling == "standard":
            return (x - F.lit(scaler.means[f])) / F.lit(scaler.stds[f] or 1.0)
        return scaler.scaled(f, x)

    return df.withColumns({scaled_name(f): value(f) for f in FEATURES})
