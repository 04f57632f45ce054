"""Scores to flags: thresholds, their source, and the reason text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.operators.features import FEATURES
from orderlens.operators.scaling import scaled_name


def norm_score(df: DataFrame, name: str = "score") -> DataFrame:
    """Length of the scaled feature vector: a model-free outlier score."""
    squares = [F.col(scaled_name(f)) * F.col(scaled_name(f)) for f in FEATURES]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return df.withColumn(name, F.sqrt(total))


def resolve_threshold(
    override: float | None, manifest: dict | None
) -> tuple[float | None, str]:
    """(threshold, source): a given value, else the manifest's, else the model's own label."""
    if override is not None:
        return float(override), "env"
    try:
        return float((manifest or {})["threshold"]), "manifest"
    except (KeyError, TypeError, ValueError):
        return None, "model-predict"


def flagged(score: Column, threshold: float | None, native: float | None = None) -> Column:
    """score >= threshold; without one, the model's own label (score > native)."""
    if threshold is not None:
        return score >= F.lit(threshold)
    return score > F.lit(native)


def reason_text(top: int = 3) -> Column:
    """The ``top`` features by absolute scaled value; ties keep feature order."""
    ranked = F.sort_array(
        F.array(
            *[
                F.struct(
                    (-F.abs(F.col(scaled_name(f)))).alias("size"),
                    F.lit(i).alias("position"),
                    F.lit(f).alias("feature"),
                )
                for i, f in enumerate(FEATURES)
            ]
        )
    )
    parts = [
        F.format_string("%s deviated strongly (%.3f)", ranked[i]["feature"], -ranked[i]["size"])
        for i in range(top)
    ]
    return F.concat_ws("; ", *parts)


def flag_rows(
    scored: DataFrame, threshold: float | None, native: float | None = None
) -> DataFrame:
    """Add ``flagged`` and ``reason``."""
    return scored.withColumns(
        {"flagged": flagged(F.col("score"), threshold, native), "reason": reason_text()}
    )
