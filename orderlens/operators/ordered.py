"""Ordered windows over groups of any size.

A window puts a whole group into one task. That is right for small groups; a
group whose sort would not stay in memory must be cut. Groups above
``CHUNK_ROWS`` are cut along the event order into chunks of about that size, each
chunk is given the last few rows before it ("history"), and running sums get
the total of the chunks before. Results equal those of the uncut window.

Where to cut is read off row counts per calendar day. When one day of one group
is itself above ``MAX_GROUP_ROWS``, the hot rows are range-partitioned on the full
order once, written, and the partition number takes the place of the day.
``max_rows`` takes the place of both limits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from orderlens.functions.exprs import join_groups
from orderlens.session import materialise, settle

MAX_GROUP_ROWS = 2_000_000
CHUNK_ROWS = 100_000
TASK_ROWS = 200_000
HASHED = 1 << 14

CHUNK, LAST, HISTORY = "_chunk", "_last_chunk", "_history"
AFTER = "_rows_after"  # rows of the chunk on later days than the row's


def groups_above(df: DataFrame, keys: list[str], max_rows: int, n: int | None = None) -> DataFrame | None:
    """Keys of the groups with more than ``max_rows`` rows; None if there are none.

    A table that is small as a whole needs no look at its groups. Otherwise rows are
    counted by a hash of their keys, at most ``HASHED`` counts a task, and groups only
    where a count is large: no group has more rows than its hash. What is kept has at
    most rows / max_rows entries. ``n`` is the number of rows, if it is known.
    """
    if (df.count() if n is None else n) <= max_rows:
        return None
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HASHED))
    sizes = df.groupBy(hashed.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    large = [r["_h"] for r in sizes.collect()]
    if not large:
        return None
    df = df.filter(hashed.isin(large))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = settle(hot.select(*keys))
    if hot.isEmpty():
        hot.unpersist()
        return None
    return hot


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Shuffle ``df`` by ``keys`` into tasks of about ``TASK_ROWS`` rows, so that their sorts stay in memory.

    Where one task a core is enough, the shuffle is left to Spark. Beyond, Spark would merge
    small partitions into tasks of 64 MB as compressed, which are many more rows.
    """
    parts = math.ceil(rows / TASK_ROWS)
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(parts, *keys)


@dataclass(frozen=True)
class OrderedGroups:
    """Rows of a table with the partition columns its ordered windows must use.

    ``size`` is their number, as far as it is known.
    """

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    size: int = 0

    @property
    def partition(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else list(self.keys)

    def window(self, *extra: str):
        return W.partitionBy(*self.partition, *extra).orderBy(*self.order)

    def gathered(self) -> OrderedGroups:
        """The rows in tasks of bounded size; right before the first window, which then needs no shuffle."""
        return replace(self, rows=spread(self.rows, self.partition, self.size))

    def with_columns(self, columns: dict[str, Column]) -> OrderedGroups:
        return replace(self, rows=self.rows.withColumns(columns))

    def running_sum(self, value: str, within: str, name: str) -> OrderedGroups:
        """Sum of ``value`` up to the row, restarted for each ``within``.

        Rows of one (group, within) must be contiguous in the order.
        """

        def joined(own: Column, before: Column) -> Column:
            # NULL only while every row so far is NULL, as in an uncut window.
            return F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0.0)))

        return self._running(F.sum, value, [within], name, joined)

    def running_max(self, value: str, name: str) -> OrderedGroups:
        """Largest ``value`` of the group up to the row."""
        return self._running(F.max, value, [], name, lambda own, before: F.greatest(own, before))

    def _running(self, fold, value: str, within: list[str], name: str, combine) -> OrderedGroups:
        own = fold(value).over(self.window(*within).rowsBetween(W.unboundedPreceding, 0))
        if not self.split:
            return self.with_columns({name: own})
        keys = [*self.keys, *within]
        per_chunk = (
            self.rows.filter(F.col(LAST) > 0).groupBy(*keys, CHUNK).agg(fold(value).alias("_total"))
        )
        before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        carried = per_chunk.select(*keys, CHUNK, fold("_total").over(before).alias("_carried"))
        carried = carried.filter(F.col("_carried").isNotNull())
        rows = join_groups(self.rows.withColumn(name, own), carried, [*keys, CHUNK])
        return replace(
            self, rows=rows.withColumn(name, combine(F.col(name), F.col("_carried"))).drop("_carried")
        )

    def with_history(self, n: int) -> OrderedGroups:
        """Give every chunk the ``n`` rows before it, marked as history.

        Two neighbouring chunks hold more than ``max_rows`` >= n rows together, so
        the tails of the two chunks before are enough. Only days that hold one of the last
        ``n`` rows of a chunk are shuffled for them.
        """
        if not self.split:
            return self
        backwards = W.partitionBy(*self.partition).orderBy(*[F.desc(c) for c in self.order])
        tails = (
            self.rows.filter((F.col(CHUNK) < F.col(LAST)) & (F.col(AFTER) < n))
            .withColumn("_back", F.row_number().over(backwards))
            .filter(F.col("_back") <= n)
            .withColumn(CHUNK, F.explode(F.array(F.col(CHUNK) + 1, F.col(CHUNK) + 2)))
            .filter(F.col(CHUNK) <= F.col(LAST))
            .drop("_back")
        )
        rows = self.rows.withColumn(HISTORY, F.lit(False)).unionByName(
            tails.withColumn(HISTORY, F.lit(True))
        )
        return replace(self, rows=rows.drop(AFTER))

    def done(self) -> DataFrame:
        """The table again, without history rows and bookkeeping columns."""
        rows = self.rows
        if HISTORY in rows.columns:
            rows = rows.filter(~F.col(HISTORY))
        return rows.drop(CHUNK, LAST, HISTORY, AFTER)


def ordered_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_rows: int | None = None,
    count_on: DataFrame | None = None,
) -> OrderedGroups:
    """Prepare ``df`` for windows over ``keys`` in ``order``, which must be unique per row.

    ``count_on`` may name a cheaper table with the same groups to read sizes from.
    """
    day_rows, max_rows = max_rows or MAX_GROUP_ROWS, max_rows or CHUNK_ROWS
    counted_on = df if count_on is None else count_on
    n = counted_on.count()
    hot = groups_above(counted_on, keys, max_rows, n)
    if hot is None:
        return OrderedGroups(df, list(keys), list(order), False, n)

    def only_hot(rows: DataFrame) -> DataFrame:
        return join_groups(rows, hot, keys, "left_semi")

    def counted(rows: DataFrame) -> DataFrame:
        return materialise(rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")), "cells")

    # A non-decreasing function of the order: the day of a timestamp, or one cell.
    if isinstance(df.schema[order[0]].dataType, T.TimestampType):
        cell = F.datediff(F.col(order[0]), F.lit("1970-01-01").cast("date"))
    else:
        cell = F.lit(0)
    daily = df.withColumn("_cell", cell)
    cells = counted(only_hot(daily))
    size = cells.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    if size["largest"] > day_rows:
        parts = 2 * math.ceil(size["total"] / max_rows)
        ranged = (
            only_hot(df)
            .repartitionByRange(parts, *keys, *order)
            .withColumn("_cell", F.spark_partition_id())
        )
        ranged = materialise(ranged, "ranged")
        cells = counted(ranged)
        cold = join_groups(df, hot, keys, "left_anti").withColumn("_cell", F.lit(0))
        daily = ranged.unionByName(cold)

    by_cell = W.partitionBy(*keys).orderBy("_cell")
    start = F.sum("_n").over(by_cell) - F.col("_n")
    by_step = W.partitionBy(*keys).orderBy("_step")
    later = W.partitionBy(*keys, CHUNK).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    chunks = settle(
        cells.withColumn("_step", F.floor(start / max_rows))
        .withColumn(CHUNK, F.dense_rank().over(by_step))
        .withColumn(LAST, F.max(CHUNK).over(W.partitionBy(*keys)))
        .withColumn(AFTER, F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .drop("_n", "_step")
    )
    rows = join_groups(daily, chunks, [*keys, "_cell"]).na.fill(0, subset=[CHUNK, LAST, AFTER])
    return OrderedGroups(rows.drop("_cell"), list(keys), list(order), True, n)
