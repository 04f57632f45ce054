"""Scalar column expressions. All stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HASH_BITS = 60
HASH_SPAN = float(1 << HASH_BITS)
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -----------------------------------------------------------------


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def lenient_double(c: Column | str) -> Column:
    """Text to double; whatever does not parse to a finite number is NULL."""
    return finite(_col(c).try_cast("double"))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def zscore(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """(value - mean) / std; 0 where the spread is zero or undefined."""
    std = _col(std)
    return F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise((_col(value) - _col(mean)) / std)


def half_up(c: Column | str, places: int) -> Column:
    """Decimal half-up rounding."""
    return F.round(_col(c).cast("decimal(38,18)"), places).cast("double")


def sorted_median(values: Column) -> Column:
    """Median of an array of doubles; NULL for an empty array."""
    s = F.sort_array(values)
    n = F.size(values)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def close_to(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """|a - b| <= tol + tol * |b|; two missing values agree."""
    return F.coalesce(F.abs(a - b) <= F.lit(tol) + F.lit(tol) * F.abs(b), a.isNull() & b.isNull())


# --- time --------------------------------------------------------------------


def parse_order_date(c: Column | str) -> Column:
    """US-style or ISO text to timestamp; NULL when neither parses."""
    c = _col(c)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm")),
        F.try_to_timestamp(c, F.lit("M/d/yyyy")),
        F.try_to_timestamp(c),
    )


def micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c))


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_DAY)))


# --- repeatable draws ----------------------------------------------------------


def hash60(seed: int, salt: str, *ids: Column | str) -> Column:
    """60 leading bits of md5("seed|salt|id...") as BIGINT.

    The same row always draws the same number, whatever the partitioning, and
    any SQL engine can repeat it.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[_col(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def uniform(seed: int, salt: str, *ids: Column | str) -> Column:
    """Repeatable draw in [0, 1)."""
    return hash60(seed, salt, *ids).cast("double") / F.lit(HASH_SPAN)


# --- joins on nullable group keys ----------------------------------------------


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a NULL key is a group of its own."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])
