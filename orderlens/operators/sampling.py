"""Repeatable samples, exact-size subsets and row numbers, without a global sort.

Every row draws a 60-bit hash from its id. "The k rows with the smallest hash" is
a simple random sample of exact size k that does not depend on partitioning. The
k-th smallest hash is found by counting, so a subset is a filter, not a sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orderlens.functions.exprs import HASH_BITS, hash60
from orderlens.session import settle

SEED = 42
BUCKET_BITS = 16
PART_ROWS = 100_000


def hash_cuts(df: DataFrame, h: Column, id_col: str, ranks: list[int]) -> list[tuple[int, str]]:
    """(hash, id) of the rank-th smallest row for each 1-based rank, exactly.

    The hash is uniform, so a rank lies within a few standard deviations of
    rank / n of the range. Rows below that bracket are counted, the few inside
    it are sorted. A bracket that misses is widened until it does not.
    """
    keyed = df.select(h.alias("h"), F.col(id_col).alias("id"))
    n = keyed.count()
    if any(r < 1 or r > n for r in ranks):
        raise ValueError(f"ranks {ranks} outside 1..{n}")
    span = 1 << HASH_BITS
    slack = 8.0
    while True:
        brackets = []
        for r in ranks:
            half = slack * math.sqrt(r) + 16
            low = max(0, int((r - half) / n * span))
            high = min(span, int((r + half) / n * span))
            brackets.append((low, high))
        below = keyed.agg(
            *[F.count(F.when(F.col("h") < low, 1)).alias(f"b{i}") for i, (low, _) in enumerate(brackets)],
            *[F.count(F.when(F.col("h") <= high, 1)).alias(f"u{i}") for i, (_, high) in enumerate(brackets)],
        ).first()
        if all(below[f"b{i}"] < r <= below[f"u{i}"] for i, r in enumerate(ranks)):
            break
        slack *= 4
    # Coarse test by leading bits: the hash is computed once per row, not per bracket.
    shift = max(max(high - low for low, high in brackets).bit_length() - 3, 0)
    buckets = {b for low, high in brackets for b in range(low >> shift, (high >> shift) + 1)}
    candidates = settle(keyed.filter(F.shiftright("h", shift).isin(sorted(buckets))))
    cuts = []
    for i, (r, (low, high)) in enumerate(zip(ranks, brackets)):
        inside = candidates.filter(F.col("h").between(low, high)).orderBy("h", "id")
        row = inside.offset(r - below[f"b{i}"] - 1).first()
        cuts.append((row["h"], row["id"]))
    candidates.unpersist()
    return cuts


def up_to(h: Column, id_col: str, cut: tuple[int, str]) -> Column:
    """Whether a row's (hash, id) is not above the cut."""
    at, last = cut
    return (h < at) | ((h == at) & (F.col(id_col) <= last))


def exact_sample(df: DataFrame, k: int, salt: str, id_col: str, seed: int = SEED) -> DataFrame:
    """A random sample of exactly min(k, n) rows."""
    if k <= 0:
        return df.limit(0)
    h = hash60(seed, salt, id_col)
    if df.count() <= k:
        return df
    return df.filter(up_to(h, id_col, hash_cuts(df, h, id_col, [k])[0]))


def disjoint_subsets(
    df: DataFrame, sizes: list[int], salt: str, id_col: str, name: str, seed: int = SEED
) -> DataFrame:
    """Add ``name``: which of the disjoint random subsets (0, 1, ...) a row is in, or NULL."""
    h = hash60(seed, salt, id_col)
    ranks, total = [], 0
    for size in sizes:
        total += size
        ranks.append(total)
    label = F.lit(None).cast("int")
    for i, cut in reversed(list(enumerate(hash_cuts(df, h, id_col, ranks)))):
        label = F.when(up_to(F.col("_h"), id_col, cut), F.lit(i)).otherwise(label)
    return df.withColumn("_h", h).withColumn(name, label).drop("_h")


def running_total_by_hash(
    df: DataFrame, h: Column, ties: list[str], weight: str, name: str
) -> DataFrame:
    """Add ``name``: sum of ``weight`` over all rows with a smaller (hash, ties).

    Rows are bucketed by the leading hash bits; only the bucket totals, of which
    there are at most 2**16, are summed in one place.
    """
    keyed = df.withColumn("_h", h)
    keyed = keyed.withColumn("_bucket", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    totals = keyed.groupBy("_bucket").agg(F.sum(weight).alias("_total"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_bucket").orderBy("_h", *ties).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return (
        keyed.withColumn("_own", own)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_own"))
        .drop("_h", "_bucket", "_own", "_offset")
    )


def block_shuffle(
    orders: DataFrame, days: int, id_col: str = "order_item_id", seed: int = SEED
) -> DataFrame:
    """Replay order: blocks of ``days`` calendar days in order, random inside a block.

    With ``days`` = 0 the order is chronological.
    """
    if not days:
        return orders.orderBy("order_date", "order_id", id_col)
    first = orders.agg(F.min(F.to_date("order_date")).alias("d")).first()["d"]
    block = F.floor(F.datediff(F.to_date("order_date"), F.lit(first)) / days)
    return (
        orders.withColumn("block", block)
        .withColumn("_h", hash60(seed, "block", id_col))
        .orderBy("block", "_h", id_col)
        .drop("_h")
    )


def block_places(
    orders: DataFrame, days: int, id_col: str = "order_item_id", seed: int = SEED, part_rows: int = PART_ROWS
) -> DataFrame:
    """Add ``block`` and ``place``, the 1-based position of a row inside its shuffled block.

    A block is cut by the leading bits of the hash into parts of about ``part_rows``
    rows. Places count from the rows of the parts before, so no window holds a block and
    nothing is sorted as a whole.
    """
    first = orders.agg(F.min(F.to_date("order_date")).alias("d")).first()["d"]
    block = F.floor(F.datediff(F.to_date("order_date"), F.lit(first)) / days)
    keyed = orders.withColumn("block", block).withColumn("_h", hash60(seed, "block", id_col))
    largest = keyed.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    bits = max(math.ceil(largest / part_rows) - 1, 0).bit_length()
    keyed = keyed.withColumn("_part", F.shiftright("_h", HASH_BITS - bits))
    sizes = keyed.groupBy(F.col("block").alias("_block"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("_block").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(sizes.select("_block", "_in", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(W.partitionBy("block", "_part").orderBy("_h", id_col))
    same = F.col("block").eqNullSafe(F.col("_block")) & (F.col("_part") == F.col("_in"))
    placed = keyed.withColumn("_own", inside).join(offsets, same)
    return placed.withColumn("place", F.col("_offset") + F.col("_own")).drop("_h", "_part", "_block", "_in", "_own", "_offset")


def replay_order(orders: DataFrame, days: int = 0, max_rows: int | None = None) -> DataFrame:
    """Dated orders in replay order, optionally only the earliest ``max_rows``."""
    ordered = block_shuffle(orders.na.drop(subset=["order_date"]), days)
    return ordered if max_rows is None else ordered.limit(max_rows)
