"""Keyed running state of the live features.

Two processors. Their state key is a bucket of many groups, so the calls from Spark
to Python are bounded by the buckets, not by the (product, region) pairs. A call gets the rows of one
bucket in one micro-batch; they are put in group and event order and handled as arrays, and the bounded
state of the bucket's groups (30 prices, or 7 quantities and two counters each) is read and written once per call.
Across micro-batches the order is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderlens.functions.exprs import MICROS_PER_DAY, join_groups, zscore
from orderlens.operators.features import CATEGORY, PRICE_FEATURE, PRICE_WINDOW, delivery_delay
from orderlens.session import ship_package
from orderlens.operators.inventory import DEMAND_WINDOW, RESTOCK_DAYS
from orderlens.sources.orders import EVENT_ORDER, PAIR_KEYS, PRICE_KEYS

# State keys. The number is part of a stored state: another one needs a new checkpoint.
BUCKETS = 1024
BUCKET, GROUP = "state_bucket", "state_group"  # no leading underscore: rows reach the task as named tuples

NO_DATE = np.iinfo(np.int64).min
SLICE = 100_000  # rows whose last values are laid out at once


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the bucket of a row and the name of its group; a NULL key is a group of its own."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    return df.withColumns({BUCKET: bucket, GROUP: F.to_json(F.struct(*keys))})


def _event_order(chunks: Iterator[pd.DataFrame], groups: list[str]) -> tuple[pd.DataFrame, pd.Index]:
    """Rows by group and event order, the group as its place among all groups of the bucket, new ones last."""
    rows = pd.concat(list(chunks), ignore_index=True)
    names = pd.Index(groups, dtype=object)
    arrived = pd.Index(rows[GROUP].unique(), dtype=object)
    names = names.append(arrived[~arrived.isin(names)])
    rows[GROUP] = names.get_indexer(rows[GROUP])
    return rows.sort_values([GROUP, *EVENT_ORDER], kind="stable", ignore_index=True), names


def _padded(values, n: int) -> np.ndarray:
    """The last ``n`` values, NaN-padded in front; NaN counts for nothing."""
    values = np.asarray(values, dtype=float)[-n:]
    return np.concatenate([np.full(n - len(values), np.nan), values])


def _extended(state: np.ndarray, groups: int, fill) -> np.ndarray:
    """``state`` with rows of ``fill`` for groups that are new."""
    more = np.full((groups - len(state), *state.shape[1:]), fill, dtype=state.dtype)
    return np.concatenate([state, more])


class _LastValues:
    """The up to ``n`` known values before each row of its group, and behind the last row.

    ``history`` holds ``n`` values per group, ``at`` the group of each row, in order.
    """

    def __init__(self, history: np.ndarray, at: np.ndarray, values: np.ndarray, known: np.ndarray) -> None:
        groups, n = history.shape
        counts = np.bincount(at[known], minlength=groups)
        starts = np.cumsum(n + counts) - (n + counts)
        seen = np.cumsum(known) - known
        within = seen - (np.cumsum(counts) - counts)[at]
        series = np.empty(groups * n + int(counts.sum()))
        series[starts[:, None] + np.arange(n)] = history
        series[(starts[at] + n + within)[known]] = values[known]
        self._windows = np.lib.stride_tricks.sliding_window_view(series, n)
        self._before, self._ends = starts[at] + within, starts + counts

    def fold(self, function, otherwise: np.ndarray) -> np.ndarray:
        """``function`` of the values before each row; ``otherwise`` where there are none."""
        out = otherwise.copy()
        for first in range(0, len(out), SLICE):
            earlier = self._windows[self._before[first : first + SLICE]]
            some = np.isfinite(earlier).any(axis=1)
            if some.any():
                out[first : first + SLICE][some] = function(earlier[some], axis=1)
        return out

    def tails(self) -> np.ndarray:
        return self._windows[self._ends]


class RollingPrice(StatefulProcessor):
    """Price deviation from the median of the last known prices of the group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._prices = handle.getValueState("prices", "groups array<string>, prices array<double>")

    def _read(self) -> tuple[list[str], np.ndarray]:
        groups, prices = (self._prices.get() if self._prices.exists() else None) or ([], [])
        return list(groups), np.asarray(prices, dtype=float).reshape(-1, PRICE_WINDOW)

    def _write(self, groups: list[str], prices: np.ndarray) -> None:
        self._prices.update((groups, prices.ravel().tolist()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        groups, prices = self._read()  # a large bucket's seeds come in several parts
        seeded = [_padded(p, PRICE_WINDOW) for p in initialState["prices"]]
        self._write(groups + initialState[GROUP].tolist(), np.concatenate([prices, np.stack(seeded)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        groups, prices = self._read()
        batch, names = _event_order(rows, groups)
        price = batch["price"].to_numpy(dtype=float)
        history = _extended(prices, len(names), np.nan)
        last = _LastValues(history, batch[GROUP].to_numpy(), price, np.isfinite(price))
        batch[PRICE_FEATURE] = price - last.fold(np.nanmedian, price)
        self._write(names.tolist(), last.tails())
        yield batch.drop(columns=[BUCKET, GROUP])

    def close(self) -> None:
        pass


class RunningStock(StatefulProcessor):
    """Stock after the order and days of cover of each (product, region) pair.

    The rows of a call are handled as arrays: the restock window in force is the
    running maximum of the windows entered, the quantity used in it a running sum
    within that window. An order of an earlier window is charged to
    the current one; a pair without history starts from base stock 0; an unknown
    quantity counts as 0, and an order without a date enters no window.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stock = handle.getValueState(
            "stock",
            "groups array<string>, base_stock array<double>, first_us array<bigint>, last_window array<bigint>, "
            "used array<double>, quantities array<double>",
        )

    def _read(self) -> tuple[list[str], list[np.ndarray]]:
        seen = (self._stock.get() if self._stock.exists() else None) or ([], [], [], [], [], [])
        kinds = [float, np.int64, np.int64, float]
        columns = [np.asarray(values, dtype=kind) for values, kind in zip(seen[1:5], kinds)]
        return list(seen[0]), [*columns, np.asarray(seen[5], dtype=float).reshape(-1, DEMAND_WINDOW)]

    def _write(self, groups: list[str], columns: list[np.ndarray]) -> None:
        self._stock.update((groups, *[c.ravel().tolist() for c in columns]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        groups, columns = self._read()  # a large bucket's seeds come in several parts
        s = initialState
        first = [NO_DATE if pd.isna(us) else int(us) for us in s["first_us"]]
        recent = np.stack([_padded(q, DEMAND_WINDOW) for q in s["quantities"]])  # unknown ones keep their place
        seeded = [s["base_stock"].to_numpy(dtype=float), np.asarray(first, dtype=np.int64)]
        seeded += [s["last_window"].to_numpy(dtype=np.int64), s["used"].to_numpy(dtype=float), recent]
        self._write(groups + s[GROUP].tolist(), [np.concatenate(pair) for pair in zip(columns, seeded)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        groups, columns = self._read()
        batch, names = _event_order(rows, groups)
        fills = [0.0, NO_DATE, 0, 0.0, np.nan]
        base, first_us, window, used, recent = [_extended(c, len(names), f) for c, f in zip(columns, fills)]
        at = batch[GROUP].to_numpy()
        dated = batch["order_us"].notna().to_numpy() & (first_us[at] != NO_DATE)
        entered = window[at]
        if dated.any():
            since = batch["order_us"].to_numpy()[dated].astype(np.int64) - first_us[at[dated]]
            entered[dated] = since // MICROS_PER_DAY // RESTOCK_DAYS
        in_force = pd.Series(np.maximum(entered, window[at])).groupby(at).cummax().to_numpy()
        quantity = np.nan_to_num(batch["quantity"].to_numpy(dtype=float))
        spent = pd.Series(quantity).groupby([at, in_force]).cumsum().to_numpy()
        spent = spent + np.where(in_force == window[at], used[at], 0.0)
        last = _LastValues(recent, at, quantity, np.ones(len(batch), bool))
        demand = last.fold(np.nanmean, quantity)
        stock = base[at] - spent
        batch["stock_after_order"] = stock
        batch["days_of_cover_remaining"] = np.where(demand > 0, stock / np.where(demand > 0, demand, 1.0), np.nan)
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        window[at[ends]], used[at[ends]] = in_force[ends], spent[ends]
        self._write(names.tolist(), [base, first_us, window, used, last.tails()])
        yield batch.drop(columns=[BUCKET, GROUP])

    def close(self) -> None:
        pass


def _plus(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, T.DoubleType()) for n in names])



def frozen_zscores(orders: DataFrame, stats: DataFrame) -> DataFrame:
    """Delay and discount-rate z-scores against frozen statistics; 0 for an unknown category or value."""
    joined = join_groups(delivery_delay(orders), stats, CATEGORY)
    return joined.withColumns(
        {
            "delivery_delay_deviation": F.coalesce(zscore("delivery_delay_days", "delay_mean", "delay_std"), F.lit(0.0)),
            "discount_rate_anomaly": F.coalesce(zscore("discount_rate", "discount_mean", "discount_std"), F.lit(0.0)),
        }
    ).drop("delay_mean", "delay_std", "discount_mean", "discount_std")


def live_features(
    orders: DataFrame, stats: DataFrame, prices: DataFrame, inventory: DataFrame
) -> DataFrame:
    """The five model features from running state; ``orders`` is a stream or a finite table.

    ``stats``, ``prices`` and ``inventory`` are the seeds of ``orderlens.streaming.seed``.
    """
    ship_package(orders.sparkSession)
    scored = frozen_zscores(orders, stats)
    priced = _bucketed(scored, PRICE_KEYS).groupBy(BUCKET).transformWithStateInPandas(
        RollingPrice(),
        outputStructType=_plus(scored.schema, PRICE_FEATURE),
        outputMode="append",
        timeMode="none",
        initialState=_bucketed(prices, PRICE_KEYS).groupBy(BUCKET),
    )
    seeded = inventory.withColumn("first_us", F.unix_micros("first_order_date")).drop("first_order_date")
    timed = priced.withColumn("order_us", F.unix_micros("order_date"))
    return (
        _bucketed(timed, PAIR_KEYS)
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            RunningStock(),
            outputStructType=_plus(timed.schema, "stock_after_order", "days_of_cover_remaining"),
            outputMode="append",
            timeMode="none",
            initialState=_bucketed(seeded, PAIR_KEYS).groupBy(BUCKET),
        )
        .drop("order_us")
    )
