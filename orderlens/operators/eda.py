"""Data shown by the exploratory notebook: shape, missing values, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.sampling import SEED, exact_sample


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def null_counts(df: DataFrame, top: int | None = 20) -> DataFrame:
    """Missing values per column, most first: one aggregate, then unpivoted."""
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    long = wide.select(F.inline(rows)).orderBy(F.desc("nulls"), "column")
    return long if top is None else long.limit(top)


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last is closed."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda b: F.lit(float(low)) + b * F.lit(width)
    return grid.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("count"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """A repeatable random sample of exactly n rows."""
    return exact_sample(df, n, "eda", id_col, seed)
