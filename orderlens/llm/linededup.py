"""Line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

A line's key is the line stripped of blanks and lower-cased (A-Z), if that has at
least ``MIN_POINTS`` code points; keys are 128-bit hashes. A state holds

* ``refs``: one row per (key, doc_id), the exact reference table;
* ``filters``: cuckoo filters by shard of the key, of two kinds: keys *held* by
  some document and keys *shared* by several. A filter is a chain of layers; a
  layer that has no room left gets a larger one behind it.

``add`` probes the *held* filters first: keys that are certainly new skip the exact
table. ``remove`` takes documents out again and deletes from the filters what no
document refers to any more. ``clean`` probes the *shared* filters, and only lines
that may be shared are joined with the exact table; a shared key loses all its
lines except in the smallest doc_id holding it.

Rows of a shard beyond ``PART_ROWS`` are dealt over several tasks, each with a copy
of that shard's filters, so a line in a third of all documents is no single task;
shards grow with the number of keys.

Defined results: a NULL or empty text is one empty line. A NULL doc_id neither holds
nor loses lines. Rows with one doc_id are one document; its rows are cleaned alike.
Other columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.text import LOWER, SPACE, U, apart, mix, range_hashes, text_chunks
from orderlens.session import materialise, ship_package

MIN_POINTS = 10
SHARD_KEYS = 50_000
PART_ROWS = 50_000
SLOTS = 4
LOAD = 0.8
KICKS = 500

_FILTER = "kind string, shard int, layer int, buckets int, used int, slots binary"


# --- cuckoo filters ----------------------------------------------------------


class Cuckoo:
    """16-bit fingerprints in buckets of four; both buckets follow from either and the fingerprint."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None, used: int = 0) -> None:
        self.buckets, self.used = buckets, used
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))))

    def room(self) -> int:
        return int(self.buckets * SLOTS * LOAD) - self.used

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scrambled = mix(keys.astype(np.int64).view(np.uint64))
        prints = (scrambled >> U(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (scrambled & U(self.buckets - 1)).astype(np.int64)
        return prints, one, self.other(prints, one)

    def other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & U(self.buckets - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(keys)
        return (self.slots[one] == prints[:, None]).any(axis=1) | (self.slots[two] == prints[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds every key once; returns those that found no place."""
        prints, one, two = self.places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two, one, two):  # whole rounds first: one key a bucket and slot
            for slot in range(SLOTS):
                free = left[self.slots[bucket[left], slot] == 0]
                _, first = np.unique(bucket[free], return_index=True)
                taken = free[first]
                self.slots[bucket[taken], slot] = prints[taken]
                left = np.setdiff1d(left, taken, assume_unique=True)
        lost = []
        for i in left.tolist():
            if not self._kick(prints[i], int(two[i])):
                lost.append(i)
        self.used += len(keys) - len(lost)
        return keys[lost]

    def _kick(self, fingerprint: np.uint16, bucket: int) -> bool:
        moved = []
        for step in range(KICKS):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fingerprint
                return True
            slot = (int(fingerprint) + step) % SLOTS
            moved.append((bucket, slot, row[slot]))
            fingerprint, row[slot] = row[slot], fingerprint
            bucket = int(self.other(np.array([fingerprint], np.uint16), np.array([bucket]))[0])
        for bucket, slot, old in reversed(moved):
            self.slots[bucket, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes one copy of every key out; returns those that are not here."""
        missing = []
        for i, (p, a, b) in enumerate(zip(*self.places(keys), strict=True)):
            for bucket in (a, b):
                found = np.flatnonzero(self.slots[bucket] == p)
                if len(found):
                    self.slots[bucket, found[0]] = 0
                    self.used -= 1
                    break
            else:
                missing.append(i)
        return keys[missing]


def _layers(rows: pd.DataFrame) -> list[Cuckoo]:
    return [
        Cuckoo(int(r.buckets), np.frombuffer(r.slots, np.uint16).reshape(-1, SLOTS).copy(), int(r.used))
        for r in rows.sort_values("layer").itertuples()
    ]


def _update(key: tuple, held: pd.DataFrame, change: pd.DataFrame, insert: bool) -> pd.DataFrame:
    kind, shard = key
    layers, keys = _layers(held), change["h1"].to_numpy(np.int64)
    if insert:
        while len(keys):
            if not layers or layers[-1].room() < len(keys):
                layers.append(Cuckoo.sized(max(len(keys), 2 * layers[-1].buckets * SLOTS if layers else 0)))
            keys = layers[-1].insert(keys)
            if len(keys):
                layers.append(Cuckoo.sized(layers[-1].buckets * SLOTS))
    else:
        # Largest layer first. Buckets of a smaller layer are the low bits of a larger one's, so a print that
        # equals a key's in a layer also equals it in all smaller ones: whichever of two such prints goes, the
        # other still answers for both keys. The other way round a print of a key found only here could go.
        for layer in reversed(layers):
            keys = layer.delete(keys)
    return pd.DataFrame(
        [(kind, shard, i, x.buckets, x.used, x.slots.tobytes()) for i, x in enumerate(layers)],
        columns=["kind", "shard", "layer", "buckets", "used", "slots"],
    )


def _insert(key: tuple, held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    return _update(key, held, change, True)


def _delete(key: tuple, held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    return _update(key, held, change, False)


def _probe(rows: pd.DataFrame, held: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    keys = rows["h1"].to_numpy(np.int64)
    found = np.zeros(len(keys), bool)
    for layer in _layers(held):
        found |= layer.has(keys)
    return rows[columns].assign(maybe=found)


# --- lines -------------------------------------------------------------------


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, number in the document, both hashes and code points of every line's key."""
    borders = np.zeros(len(data) + 1, np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    sizes = np.concatenate(([0], np.cumsum(data == 0x0A)))
    count = sizes[offsets[1:]] - sizes[offsets[:-1]] + 1
    doc = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    solid = np.flatnonzero(~SPACE[data])
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    some = last >= first
    s = np.where(some, solid[np.minimum(first, len(solid) - 1)] if len(solid) else 0, start)
    e = np.where(some, solid[np.maximum(last, 0)] + 1 if len(solid) else 0, s)
    borders[1:] = np.cumsum((data & 0xC0) != 0x80)
    lower = LOWER[data]
    return doc, pos, range_hashes(lower, s, e), range_hashes(lower, s, e, 1), borders[e] - borders[s]


def _lines(batches: Iterator[pa.RecordBatch], min_points: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text")):
            doc, pos, h1, h2, points = line_keys(data, offsets)
            keep = points >= min_points
            rows = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i).take(rows),
                    batch.column("text_hash").slice(i, j - i).take(rows),
                    pa.array(pos[keep].astype(np.int32)),
                    pa.array(h1[keep].view(np.int64)),
                    pa.array(h2[keep].view(np.int64)),
                ],
                names=["doc_id", "text_hash", "pos", "h1", "h2"],
            )


def lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): every line whose key is long enough; written."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return materialise(
        rows.mapInArrow(partial(_lines, min_points=min_points), "doc_id long, text_hash long, pos int, h1 long, h2 long"), "line-rows"
    )


@dataclass(frozen=True)
class LineState:
    """Exact references and the filters before them."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_points: int = MIN_POINTS


def _shard(state_shards: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(state_shards)).cast("int")


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def empty_state(rows: DataFrame, min_points: int = MIN_POINTS) -> LineState:
    """No documents yet; the number of shards follows the lines expected (``rows``)."""
    spark = rows.sparkSession
    return LineState(
        spark.createDataFrame([], "h1 long, h2 long, doc_id long"),
        spark.createDataFrame([], _FILTER),
        max(1, -(-rows.count() // SHARD_KEYS)),
        min_points,
    )


def _changed(filters: DataFrame, keys: DataFrame, how) -> DataFrame:
    """Filters with (kind, shard, h1) put in or taken out."""
    ship_package(filters.sparkSession)
    return filters.groupBy("kind", "shard").cogroup(keys.groupBy("kind", "shard")).applyInPandas(how, _FILTER)


def probe(state: LineState, rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (h1, h2 and more) with ``maybe``: false if no key of that kind equals the row's."""
    ship_package(rows.sparkSession)
    rows = rows.withColumn("shard", _shard(state.shards))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sizes = materialise(sizes, "line-shards")
    # By the row itself: a recomputed task deals its rows to the same parts.
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("parts")).cast("int")
    dealt = rows.join(sizes, "shard").withColumn("part", part).drop("parts")
    copies = (
        state.filters.filter(F.col("kind") == kind)
        .join(sizes, "shard")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    columns = [c for c in rows.columns if c != "shard"]
    kinds = dict(rows.dtypes)
    return (
        dealt.groupBy("shard", "part")
        .cogroup(copies.groupBy("shard", "part"))
        .applyInPandas(partial(_probe, columns=columns), ", ".join([*(f"{c} {kinds[c]}" for c in columns), "maybe boolean"]))
    )


def add(state: LineState, rows: DataFrame) -> LineState:
    """The state with the documents of these ``lines``; references it has already are not counted twice."""
    new = rows.select("h1", "h2", "doc_id")
    keys = new.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    if state.filters.isEmpty():
        fresh = known = materialise(keys.withColumns({"old_first": F.lit(None).cast("long"), "old_last": F.lit(None).cast("long")}), "line-keys")
    else:
        tested = materialise(probe(state, keys, "held"), "line-probed")
        old = _counts(state.refs).toDF("h1", "h2", "old_first", "old_last")
        known = tested.filter("maybe").drop("maybe").join(old, ["h1", "h2"], "left")
        sure = tested.filter("not maybe").drop("maybe")
        known = materialise(
            known.unionByName(sure.withColumns({"old_first": F.lit(None).cast("long"), "old_last": F.lit(None).cast("long")})),
            "line-keys",
        )
        fresh = known.filter("old_first is null")
    shared_now = F.least("first_doc", "old_first") < F.greatest("last_doc", "old_last")
    shared_before = F.coalesce(F.col("old_first") < F.col("old_last"), F.lit(False))
    shared = known.filter(shared_now & ~shared_before)
    shard = _shard(state.shards)
    put = fresh.select(F.lit("held").alias("kind"), shard.alias("shard"), "h1").union(
        shared.select(F.lit("shared").alias("kind"), shard.alias("shard"), "h1")
    )
    refs = state.refs.union(new)
    refs = new if state.filters.isEmpty() else materialise(refs.distinct(), "line-refs")
    return LineState(refs, materialise(_changed(state.filters, put, _insert), "line-filters"), state.shards, state.min_points)


def remove(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents of column ``doc_id``: as if they had never been added."""
    ids = doc_ids.select("doc_id").distinct()
    gone = state.refs.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct()
    left = materialise(state.refs.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id"), "line-refs")
    before = _counts(state.refs.join(gone, ["h1", "h2"], "left_semi"))
    after = _counts(left.join(gone, ["h1", "h2"], "left_semi")).toDF("h1", "h2", "new_first", "new_last")
    both = materialise(before.join(after, ["h1", "h2"], "left"), "line-gone")
    shard = _shard(state.shards)
    out = both.filter("new_first is null").select(F.lit("held").alias("kind"), shard.alias("shard"), "h1").union(
        both.filter("first_doc < last_doc and not coalesce(new_first < new_last, false)").select(
            F.lit("shared").alias("kind"), shard.alias("shard"), "h1"
        )
    )
    return LineState(left, materialise(_changed(state.filters, out, _delete), "line-filters"), state.shards, state.min_points)


def clean(state: LineState, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; kept lines stay in order.

    ``rows`` are the ``lines`` of ``docs``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = lines_of(text)
    maybe = probe(state, rows, "shared").filter("maybe")
    shared = _counts(state.refs).filter("first_doc < last_doc").select("h1", "h2", "first_doc")
    dropped = (
        maybe.join(shared, ["h1", "h2"])
        .filter("doc_id > first_doc")
        .select("doc_id", "text_hash", "pos")
        .distinct()
        .groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_list("pos").alias("__dropped"))
    )
    dropped = materialise(dropped, "line-dropped")
    whole, cut = apart(docs, "doc_id", dropped, "__doc")
    joined = cut.join(dropped, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    joined = joined.unionByName(whole, allowMissingColumns=True)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("__dropped").isNull(), text).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """All documents added to an empty state, then cleaned with it."""
    rows = lines(docs, min_points)
    return clean(add(empty_state(rows, min_points), rows), docs, rows)
