"""N-gram Jaccard join: index lists skipped by blocks, answers derived along set relations.

``jaccard_components`` links documents whose sets of distinct k-word shingles have
100 * intersection >= percent * union, exactly, and names each document's component.

1. One pass over the texts gives each set's size and key (64-bit hash of the set) and
   counts shingles in ``SLOTS`` slots by hash. Equal sets are one node from here on.
2. A set's shingles are put in order of their slot's count, rarest first. Sets that
   link share one of their first n - ceil(percent * n / 100) + 1 shingles, at places
   that leave room for the overlap they need. Each such shingle has an index list of
   (set, size, place); lists of one set go.
3. Set relations skip most of a list. A list's leader meets its members and leaves the
   list; what links with it is in its component, and members of one component never
   meet again. Lists that still hold several components get other leaders; at last every pair of different
   components is listed: entries are sorted by size and place and cut into blocks, and
   a pair of blocks is skipped if sizes or places rule all its pairs out. A long list
   is dealt out as pairs of slices, so no list has to fit one task.
4. Overlaps with leaders are kept as computed answers, and a set that links with its
   leader is stored as the few shingles it lacks and has besides. For a further pair of
   such a set and another one, the overlap follows from the leader's answer and these
   differences; the set itself is not read again. A pair whose bound (the leader's
   overlap and all added shingles) is too small is dropped before that.
5. Components come from star contraction of the links.

Defined results: NULL, empty or word-free texts have 0 shingles and link with nothing.
Fewer than k words make one shingle of all words. A NULL doc_id takes no part: its
component is NULL. Rows with one doc_id may have different sets, each of its own
component. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.graph import components
from orderlens.llm.text import list_column, shingle_sets, text_chunks
from orderlens.session import materialise, ship_package

SLOT_BITS = 18
LEADER_ROUNDS = 4
SLICE = 4096  # entries of one list that meet in one group
BLOCK = 64  # entries that are skipped together
IDS_SENT = 1_000_000  # ids sent to all tasks at most, 8 bytes each; more are joined by shuffle

_MADE = "doc_id long, n_shingles long, key long, slot int, seen long"
_ENTRY = "token long, key long, n int, pos int"


def _key(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Size and key of each set; at the end how often each slot was seen."""
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    names = ["doc_id", "n_shingles", "key", "slot", "seen"]
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text")):
            sets = list(shingle_sets(data, offsets, k))
            if any(map(len, sets)):
                seen += np.bincount(_slots(np.concatenate(sets)), minlength=len(seen))
            none = pa.nulls(j - i)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.int64()),
                    none.cast(pa.int32()),
                    none.cast(pa.int64()),
                ],
                names=names,
            )
    used = np.flatnonzero(seen)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(part.astype(np.int32)), pa.array(seen[part])], names=names
        )


def prefix(shingles: np.ndarray, percent: int, seen: np.ndarray) -> np.ndarray:
    """The shingles of which linked sets must share one, rarest slot first."""
    n = len(shingles)
    return shingles[np.lexsort((shingles, seen[_slots(shingles)]))][: n + percent * -n // 100 + 1]


def _entry_batch(keys: np.ndarray, sets: list[np.ndarray], percent: int, seen: np.ndarray) -> pa.RecordBatch:
    first = [prefix(s, percent, seen) for s in sets]
    sizes = np.array([len(x) for x in first])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(first).view(np.int64)),
            pa.array(np.repeat(keys, sizes)),
            pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), sizes)),
            pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)),
        ],
        names=["token", "key", "n", "pos"],
    )


def _entries(batches: Iterator[pa.RecordBatch], k: int, percent: int, seen) -> Iterator[pa.RecordBatch]:
    counts = np.frombuffer(seen.value, np.int64)
    for batch in batches:
        for _, _, offsets, data in text_chunks(batch.column("text")):
            sets = [s for s in shingle_sets(data, offsets, k) if len(s)]
            if sets:
                yield _entry_batch(np.array([_key(s) for s in sets], np.int64), sets, percent, counts)


def _entries_of(batches: Iterator[pa.RecordBatch], percent: int, seen) -> Iterator[pa.RecordBatch]:
    counts = np.frombuffer(seen.value, np.int64)
    for batch in batches:
        lists = batch.column("shingles")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if sets:
            yield _entry_batch(batch.column("key").to_numpy(), sets, percent, counts)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, offsets, data in text_chunks(batch.column("text")):
            sets = [s for s in shingle_sets(data, offsets, k) if len(s)]
            if sets:
                lists = list_column(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), lists], names=["key", "shingles"])


# --- lists -------------------------------------------------------------------


def needed(n_a, n_b, percent: int):
    """Least overlap of linked sets of these sizes; columns or arrays."""
    total = (n_a + n_b) * percent + (99 + percent)
    return F.floor(total / (100 + percent)) if not isinstance(total, np.ndarray) else total // (100 + percent)


def _fits(percent: int):
    """Condition on two entries a and b of one list: sizes and places leave room for a link."""
    room = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (
        room >= needed(F.col("n_a"), F.col("n_b"), percent)
    )


def lists_of(entries: DataFrame) -> DataFrame:
    """(token, key, n, pos) of the lists that hold several sets; written."""
    shared = entries.groupBy("token").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select("token")
    return materialise(entries.join(shared, "token").distinct(), "setjoin-lists")


def crossing(n: np.ndarray, pos: np.ndarray, component: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one list in different components that may link; with sides, only pairs of different sides.

    Entries are taken in order of size and place, in blocks; two blocks are skipped if
    the least and largest sizes are too far apart or the earliest places leave too
    little room.
    """
    order = np.lexsort((pos, n))
    n, pos, component = n[order].astype(np.int64), pos[order].astype(np.int64), component[order]
    side = np.zeros(len(n), bool) if side is None else side[order]
    cut = side.any()
    starts = range(0, len(n), BLOCK)
    room = n - pos
    most = [room[s : s + BLOCK].max() for s in starts]
    left, right = [], []
    for y, s in enumerate(starts):
        e = min(s + BLOCK, len(n))
        for x in range(y, -1, -1):
            a, b = x * BLOCK, min((x + 1) * BLOCK, len(n))
            if 100 * n[b - 1] < percent * n[s]:
                break  # all earlier blocks hold smaller sets still
            if min(most[x], most[y]) < (n[a] + n[s]) * percent / (100 + percent):
                continue
            fit = 100 * np.minimum(n[a:b, None], n[None, s:e]) >= percent * np.maximum(n[a:b, None], n[None, s:e])
            fit &= np.minimum(room[a:b, None], room[None, s:e]) >= needed(n[a:b, None], n[None, s:e], percent)
            fit &= component[a:b, None] != component[None, s:e]
            if cut:
                fit &= side[a:b, None] != side[None, s:e]
            if x == y:
                fit = np.triu(fit, 1)
            i, j = np.nonzero(fit)
            left.append(order[i + a])
            right.append(order[j + s])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``keys``, many at once, and where each group starts."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in keys:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        kept.append(batch)
        table = pa.Table.from_batches(kept).combine_chunks()
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
            kept = table.slice(at[-1]).to_batches()
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        if table.num_rows:
            yield table, starts(table)


def _pairs_of(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for table, starts in _groups(batches, ["token", "low", "high"]):
        n, pos, component, key, slice_, low, high = (
            table.column(c).to_numpy() for c in ("n", "pos", "component", "key", "slice", "low", "high")
        )
        ends = np.append(starts[1:], table.num_rows)
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            side = None if low[s] == high[s] else slice_[s:e] == high[s]
            a, b = crossing(n[s:e], pos[s:e], component[s:e], side, percent)
            left.append(a + s)
            right.append(b + s)
        a, b = np.concatenate(left), np.concatenate(right)
        a, b = np.where(key[a] < key[b], a, b), np.where(key[a] < key[b], b, a)
        pairs = np.unique(np.stack((key[a], key[b])), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def crossing_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All (a, b) of lists (with component) that may link and are not of one component."""
    sizes = lists.groupBy("token").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    dealt = (
        lists.join(sizes, "token")
        .withColumn("slice", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("*", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"))
        .drop("other", "slices")
    )
    by = ["token", "low", "high"]
    grouped = dealt.repartition(*by).sortWithinPartitions(*by)
    return grouped.mapInArrow(partial(_pairs_of, percent=percent), "a long, b long").distinct()


# --- answers -----------------------------------------------------------------


def _linked(common, percent: int):
    return common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent


def _among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ``ids``: sent to all tasks if they are few (counted), else shuffled."""
    few = ids.count() <= IDS_SENT
    return rows.join(F.broadcast(ids) if few else ids, column, "left_semi")


def _answers(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, common, linked, lacks, adds) from full sets; the differences of b to a only where linked; written."""
    pairs = materialise(pairs.select("a", "b"), "setjoin-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _among(sets, materialise(asked, "setjoin-asked"), "key")
    met = (
        pairs.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .select("*", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"))
        .withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        .withColumn("linked", _linked(F.col("common"), percent))
    )
    return materialise(
        met.select(
            "a", "b", "n_a", "n_b", "common", "linked",
            F.when(F.col("linked"), F.array_except("set_a", "set_b")).alias("lacks"),
            F.when(F.col("linked"), F.array_except("set_b", "set_a")).alias("adds"),
        ),
        "setjoin-answers",
    )


def _derived(pairs: DataFrame, answers: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the links; answers of leaders are used where one end has a leader. Written.

    ``answers`` are overlaps (a leader, b member) computed so far.
    """
    related = answers.filter("linked").groupBy("b").agg(
        F.min(F.struct("a", "n_b", "lacks", "adds")).alias("r")
    ).select(F.col("b").alias("y"), F.col("r.a").alias("x"), F.col("r.n_b").alias("n_y"), F.col("r.lacks").alias("lacks"), F.col("r.adds").alias("adds"))
    related = materialise(related, "setjoin-relations")
    has = related.select("y")
    ends = pairs.join(has.toDF("a").withColumn("of_a", F.lit(True)), "a", "left").join(
        has.toDF("b").withColumn("of_b", F.lit(True)), "b", "left"
    )
    ends = materialise(
        ends.select(
            F.when(F.col("of_a").isNotNull(), F.col("a")).when(F.col("of_b").isNotNull(), F.col("b")).alias("y"),
            F.when(F.col("of_a").isNull() & F.col("of_b").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("z"),
            "a",
        ),
        "setjoin-ends",
    )
    plain = _answers(ends.filter("y is null").select("a", F.col("z").alias("b")), sets, percent)
    asked = ends.filter("y is not null").select("y", "z").join(related, "y")
    known = answers.select(F.col("a").alias("x"), F.col("b").alias("z"), "common").union(
        answers.select(F.col("b").alias("x"), F.col("a").alias("z"), "common")
    )
    missing = asked.filter("x != z").select("x", "z").distinct().join(known, ["x", "z"], "left_anti")
    computed = _answers(missing.toDF("a", "b"), sets, percent).select(F.col("a").alias("x"), F.col("b").alias("z"), "common")
    sizes = sets.select(F.col("key").alias("z"), F.size("shingles").alias("n_z"))
    bounded = (
        asked.join(known.union(computed).dropDuplicates(["x", "z"]), ["x", "z"])
        .join(sizes, "z")
        .filter(F.col("common") + F.size("adds") >= needed(F.col("n_y"), F.col("n_z"), percent))
        .join(sets.toDF("z", "set_z"), "z")
        .withColumn(
            "overlap",
            F.col("common") - F.size(F.array_intersect("lacks", "set_z")) + F.size(F.array_intersect("adds", "set_z")),
        )
        .filter(F.col("overlap") * 100 >= (F.col("n_y") + F.col("n_z") - F.col("overlap")) * percent)
        .select(F.col("y").alias("a"), F.col("z").alias("b"))
    )
    return materialise(bounded.union(plain.filter("linked").select("a", "b")), "setjoin-links")


def resolve(lists: DataFrame, sets: DataFrame, percent: int, before: DataFrame | None = None) -> DataFrame:
    """(node, component) of all links among the sets of ``lists``; ``before`` are links (a, b) known already.

    ``sets`` are (key, shingles); a key may have several rows of the same set.
    """
    spark = lists.sparkSession
    found = spark.createDataFrame([], "node long, component long")
    if before is not None:
        found = materialise(components(before), "setjoin-components")
    answers = spark.createDataFrame(
        [], "a long, b long, n_a int, n_b int, common int, linked boolean, lacks array<long>, adds array<long>"
    )
    active = lists
    for turn in range(LEADER_ROUNDS + 1):
        named = active.join(found.toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        # At first one leader for many lists, so that pairs repeat; later each list has its own.
        draw = F.xxhash64("key") if turn == 0 else F.xxhash64("key", "token", F.lit(turn))
        lead = (
            named.groupBy("token")
            .agg(
                F.min("component").alias("x"),
                F.max("component").alias("y"),
                F.min(F.struct(draw.alias("draw"), "key", "n", "pos", "component")).alias("l"),
            )
            .filter("x < y")
            .select("token", "l")
        )
        active = materialise(named.join(lead, "token"), "setjoin-open")
        if active.isEmpty():
            return found
        if turn == LEADER_ROUNDS:
            break
        pairs = (
            active.filter(F.col("l.component") != F.col("component"))
            .select(
                F.col("l.key").alias("a"), F.col("l.n").alias("n_a"), F.col("l.pos").alias("pos_a"),
                F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"),
            )
            .filter(_fits(percent))
            .select("a", "b")
            .distinct()
        )
        now = _answers(pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti"), sets, percent)
        answers = answers.unionByName(now)
        links = found.toDF("a", "b").union(now.filter("linked").select("a", "b"))
        found = materialise(components(links), "setjoin-components")
        # The leader has met its whole list.
        active = active.filter("key != l.key").select("token", "key", "n", "pos")
    pairs = crossing_pairs(active.drop("l"), percent).join(answers.select("a", "b"), ["a", "b"], "left_anti")
    left = _derived(materialise(pairs, "setjoin-remaining"), answers, sets, percent)
    return materialise(components(found.toDF("a", "b").union(left)), "setjoin-components")


def _collected(counted: DataFrame):
    """Counts of the slots as a broadcast; at most 2**SLOT_BITS rows."""
    table = counted.groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    seen[table.column("slot").to_numpy()] = table.column("seen").to_numpy()
    return counted.sparkSession.sparkContext.broadcast(seen.tobytes())


def measure(texts: DataFrame, k: int) -> tuple[DataFrame, object]:
    """(doc_id, n_shingles, key) of every row, and the counts of the slots as a broadcast of fixed size."""
    ship_package(texts.sparkSession)
    made = materialise(texts.mapInArrow(partial(_measure, k=k), _MADE), "setjoin-made")
    return made.filter("slot is null").select("doc_id", "n_shingles", "key"), _collected(made.filter("slot is not null"))


def index(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (token, key, n, pos) of sets (key, shingles) that are at hand; written."""
    slot = F.shiftrightunsigned("token", 64 - SLOT_BITS).cast("int").alias("slot")
    counted = sets.select(F.explode("shingles").alias("token")).groupBy(slot).agg(F.count("*").alias("seen"))
    entries = sets.mapInArrow(partial(_entries_of, percent=percent, seen=_collected(counted)), _ENTRY)
    return materialise(entries, "setjoin-index")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, seen = measure(texts, k)
    entries = texts.filter("doc_id is not null").mapInArrow(partial(_entries, k=k, percent=percent, seen=seen), _ENTRY)
    lists = lists_of(materialise(entries, "setjoin-index"))
    holders = materialise(
        made.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "setjoin-classes"
    )
    met = materialise(lists.select("key").distinct(), "setjoin-met")
    of = materialise(holders.join(met, "key").select("doc_id").distinct(), "setjoin-holders")
    sets = _among(texts, of, "doc_id").mapInArrow(partial(_sets, k=k), "key long, shingles array<long>")
    sets = materialise(_among(sets, met, "key"), "setjoin-sets")
    found = resolve(lists, sets, percent).toDF("key", "root")
    rooted = holders.join(found, "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.col("doc_id").alias("class_id"))
    smallest = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "class_id", "component_id")
    known = F.col("doc_id").isNotNull()
    return made.join(named, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )
