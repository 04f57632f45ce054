"""Exact quantiles with linear interpolation, for groups of any size.

``percentile`` keeps every distinct value of a group in one task, so it is used
only while every group is known to be small. Beyond that a mergeable sketch
brackets the wanted rank, values below the bracket are only counted, and the
exact value is picked from the few distinct values inside it. While more of them
are inside than one task should sort, the bracket is cut into cells, the rows of
each cell are counted, and only the cells that hold the rank stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from orderlens.functions.exprs import join_groups
from orderlens.operators.ordered import MAX_GROUP_ROWS, groups_above
from orderlens.session import materialise

ACCURACY = 20_000
PICKED_FROM = 200_000  # distinct values that one task sorts
CELLS = 64


def grouped_percentiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, float]],
    max_rows: int | None = None,
    accuracy: int = ACCURACY,
    picked_from: int = PICKED_FROM,
) -> DataFrame:
    """One row per group with ``{name: (column, p)}`` percentiles; NULLs are left out."""
    max_rows = max_rows or MAX_GROUP_ROWS
    if not keys:
        return _all_rows(df, wanted, max_rows, accuracy, picked_from)
    hot = groups_above(df, keys, max_rows)
    if hot is None:
        return _direct(df, keys, wanted)
    small = _direct(join_groups(df, hot, keys, "left_anti"), keys, wanted)
    large = _bracketed(join_groups(df, hot, keys, "left_semi"), keys, wanted, accuracy, picked_from)
    return small.unionByName(large)


def percentile_values(
    df: DataFrame, wanted: dict[str, tuple[str, float]], max_rows: int | None = None
) -> dict[str, float | None]:
    """Percentiles of the whole table, as numbers (one row reaches the driver)."""
    return grouped_percentiles(df, [], wanted, max_rows).first().asDict()


def _direct(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.percentile(c, p).alias(name) for name, (c, p) in wanted.items()]
    )


def _all_rows(df, wanted, max_rows, accuracy, picked_from) -> DataFrame:
    if df.count() <= max_rows:
        return _direct(df, [], wanted)
    tagged = df.withColumn("_all", F.lit(1))
    return _bracketed(tagged, ["_all"], wanted, accuracy, picked_from).drop("_all")


def _narrowed(inside: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """``inside`` without the cells that do not hold the ranks; those below them join the count of the rows below.

    Cells are cut by a sketch but counted exactly, so a poor cut costs a round, not the result.
    """
    edges = inside.filter("not below").groupBy(*by).agg(
        F.percentile_approx("x", [i / CELLS for i in range(1, CELLS)], ACCURACY).alias("_edges")
    )
    cell = F.when(F.col("below"), -1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col("x"))))
    celled = join_groups(inside, edges, by).withColumn("_cell", cell).drop("_edges")
    upto = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)  # at most CELLS + 1 rows
    totals = celled.groupBy(*by, "_cell").agg(F.sum("_m").alias("_m")).withColumn("_upto", F.sum("_m").over(upto))
    holds = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_cell")))
    wanted = join_groups(totals, ranks, by).groupBy(*by).agg(
        F.greatest(holds(F.floor("_rank")), F.lit(0)).alias("_from"), holds(F.ceil("_rank")).alias("_to")
    )
    kept = join_groups(celled, wanted, by).filter(F.col("_cell") <= F.col("_to"))
    under = F.col("_cell") < F.col("_from")
    kept = kept.select(*by, under.alias("below"), F.when(~under, F.col("x")).alias("x"), "_m")
    return materialise(kept.groupBy(*by, "below", "x").agg(F.sum("_m").alias("_m")), "bracket")


def _bracketed(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int, picked_from: int
) -> DataFrame:
    names = list(wanted)
    margin = 2.0 / accuracy
    sketch = []
    for name, (c, p) in wanted.items():
        ends = F.array(F.lit(max(p - margin, 0.0)), F.lit(min(p + margin, 1.0)))
        sketch += [
            F.count(c).alias(f"_n_{name}"),
            F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias(f"_ends_{name}"),
        ]
    bounds = df.groupBy(*keys).agg(*sketch)

    # One slot per wanted value; rows below the bracket collapse into one count,
    # rows above it into none.
    def slot(name: str):
        x = F.col(wanted[name][0]).cast("double")
        low, high = F.col(f"_ends_{name}")[0], F.col(f"_ends_{name}")[1]
        return F.struct(
            F.lit(name).alias("name"),
            (x < low).alias("below"),
            F.when(x >= low, x).alias("x"),
            (x <= high).alias("keep"),
        )

    inside = (
        join_groups(df, bounds, keys)
        .select(*keys, F.explode(F.array(*[slot(n) for n in names])).alias("s"))
        .filter(F.col("s.keep"))
        .groupBy(*keys, "s.name", "s.below", "s.x")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    by = [*keys, "name"]
    sizes = bounds.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), F.col(f"_n_{n}").alias("n"), F.lit(wanted[n][1]).alias("p"))
                    for n in names
                ]
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    ranks = materialise(sizes.select(*by, (F.col("p") * (F.col("n") - 1)).alias("_rank")), "ranks")
    inside = materialise(inside, "bracket")
    most = lambda: inside.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    rows, before = most(), None
    while rows > picked_from and rows != before:
        inside = _narrowed(inside, ranks, by)
        rows, before = most(), rows
    upto = W.partitionBy(*by).orderBy(F.desc("below"), "x").rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_m").over(upto)).filter(~F.col("below"))
    placed = join_groups(ranked, ranks, by)
    at = {
        "low": F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("x"))),
        "high": F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("x"))),
    }
    first_inside = F.min(F.col("_upto") - F.col("_m")) <= F.floor(F.first("_rank"))
    picked = placed.groupBy(*keys, "name").agg(
        at["low"].alias("low"),
        at["high"].alias("high"),
        F.first("_rank").alias("_rank"),
        first_inside.alias("_ok"),
    )
    # The sketch's error bound puts both ranks inside the bracket; stop if it ever fails.
    value = F.when(
        F.col("_ok") & F.col("low").isNotNull() & F.col("high").isNotNull(),
        F.col("low") + (F.col("_rank") - F.floor("_rank")) * (F.col("high") - F.col("low")),
    ).otherwise(F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"))
    values = picked.select(*keys, "name", value.alias("value"))
    found = values.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )
    return join_groups(bounds.select(*keys), found, keys)
