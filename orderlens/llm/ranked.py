"""Ranked lexical search by hashed max-sketches.

A term's weight w falls with its document frequency; a document's impact of a term is
(10**9 * tf) div (1000 * tf + 12 * m), where m grows with the document's length. An
item's score of a document is the sum of w * impact over the item's terms, repeats
included (all 64-bit integers; w from doubles, rounded down).

1. One pass over the texts counts terms and the documents that hold the items' terms,
   and folds each document's term frequencies into a sketch: a term falls into one of
   2**bits coordinates by hash, a coordinate keeps the largest frequency. Impacts grow
   with the frequency, so this is the coordinatewise maximum of the impacts as well,
   known once the corpus totals are. A sketch has ``SPREAD`` to twice as many
   coordinates as the document has terms; only those in use are stored.
2. Batched lookups: the items' terms are read from the sketches of many documents at
   once, and one matrix product gives upper bounds of all items' scores.
3. Exact rescoring by descending bound: the ``FIRST`` highest bounds of each item are
   rescored from the texts; the k-th best score so far is the threshold. Every pair
   whose bound reaches it is written once; the ``SECOND`` highest of these are rescored,
   and then all pairs whose bound reaches the threshold reached by then. A document that
   is left out has a bound, so a score, below k others. Of documents with the same bag
   of terms only the k smallest doc_ids can be found, so a group of copies of any size
   costs k pairs an item.

Items are taken in blocks of at most ``BLOCK_TERMS`` pairs of item and term (or one
item), which is what the driver and the tasks hold; documents are never gathered.

Defined results: NULL and empty texts, and texts without terms, have no terms and are
never found. NULL and repeated item_ids are items of their own. A document with a NULL
doc_id counts in the totals but is not returned; rows with one doc_id are documents of
their own. Equal scores rank by doc_id. Scores of 0 are not returned. Other columns are
not read. Empty tables give no rows. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from orderlens.llm.text import LOWER, mix, range_hashes, text_chunks, words
from orderlens.session import materialise, ship_package

SPREAD = 16
LEAST_BITS, MOST_BITS = 6, 24
FULL = 255  # a frequency that is not stored exactly counts as unbounded
BLOCK_TERMS = 200_000
FIRST = 40  # bounds of each item that are rescored first
SECOND = 320  # bounds of each item that are rescored then, before all that still reach the threshold
CELLS = 1 << 22  # cells of sketches and of bounds that are spread out at once
IDS_SENT = 1_000_000

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_MADE = "doc_id long, n long, bag long, bits int, sketch binary, term int, df long"
_PAIR = "item int, doc_id long, bag long, bound long"


@dataclass(frozen=True)
class Items:
    """The items of a block: distinct term hashes in order, and for each item the terms and how often it has them."""

    terms: np.ndarray
    places: tuple[np.ndarray, ...]
    times: tuple[np.ndarray, ...]


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, frequency) of all distinct terms of each document, and terms with repeats per document."""
    s, e, first = words(data, offsets, OUTSIDE)
    n = np.diff(first)
    hashes = range_hashes(LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc))), n


def bits_for(distinct: np.ndarray) -> np.ndarray:
    need = np.ceil(np.log2(np.maximum(distinct, 1) * SPREAD)).astype(np.int64)
    return np.clip(need, LEAST_BITS, MOST_BITS)


def coordinate(hashes: np.ndarray, bits) -> np.ndarray:
    return mix(hashes) >> (np.uint64(64) - np.asarray(bits, np.uint64))


def _sketches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    held = np.zeros(len(items.terms), np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.int64()), ("bits", pa.int32()), ("sketch", pa.binary()), ("term", pa.int32()), ("df", pa.int64())])
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text")):
            doc, hashes, tf, n = terms_of(data, offsets)
            place, known = find(items.terms, hashes)
            held += np.bincount(place[known], minlength=len(held))
            distinct = np.bincount(doc, minlength=j - i)
            bits = bits_for(distinct)
            at = coordinate(hashes, bits[doc])
            cell = (at << np.uint64(8)) | np.minimum(tf, FULL).astype(np.uint64)
            terms, bag = doc, np.stack((hashes, tf.astype(np.uint64)), axis=1)
            order = np.lexsort((cell, doc))
            doc, cell = doc[order], cell[order]
            # Of the terms of one coordinate the last has the largest frequency.
            last = np.ones(len(doc), bool)
            last[:-1] = (doc[1:] != doc[:-1]) | (cell[1:] >> np.uint64(8) != cell[:-1] >> np.uint64(8))
            raw = cell[last].astype(np.uint32).tobytes()
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc[last], minlength=j - i)))) * 4
            none = pa.nulls(j - i)
            cuts = np.searchsorted(terms, np.arange(j - i + 1)).tolist()
            bags = [int.from_bytes(xxhash.xxh3_64_digest(bag[a:b].tobytes()), "big", signed=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(bags, pa.int64()), pa.array(bits.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]),
                    none.cast(pa.int32()), none.cast(pa.int64()),
                ],
                schema=schema,
            )
    used = np.flatnonzero(held)
    if len(used):
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays(
            [*(none.cast(f.type) for f in list(schema)[:5]), pa.array(used.astype(np.int32)), pa.array(held[used])], schema=schema
        )


def find(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes among the sorted terms, and which are there."""
    if not len(terms):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return at, terms[at] == hashes


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 12 * m, 1)


def length_norm(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 100 - 25 + (25 * n * documents) // max(length, 1)


def bounds(sketches: list[bytes], bits: np.ndarray, m: np.ndarray, items: Items, weights: np.ndarray) -> np.ndarray:
    """Upper bounds of every item's score (documents x items)."""
    out = np.zeros((len(sketches), len(items.places)))
    by_item = np.zeros((len(items.terms), len(items.places)))
    for i, (at, times) in enumerate(zip(items.places, items.times, strict=True)):
        by_item[at, i] = times * weights[at]
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        asked = coordinate(items.terms, b).astype(np.int64)
        step = max(1, CELLS // max(1 << b, len(asked)))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            raw = [sketches[r] for r in part.tolist()]
            cells = np.frombuffer(b"".join(raw), np.uint32)
            row = np.repeat(np.arange(len(part)), [len(x) // 4 for x in raw])
            spread = np.zeros((len(part), 1 << b), np.uint8)
            spread[row, cells >> 8] = cells & 255
            tf = spread[:, asked].astype(np.int64)
            top = impacts(tf, m[part, None])
            top[tf == FULL] = 1_000_000
            out[part] = top.astype(np.float64) @ by_item  # whole numbers below 2**53
    return out


def _bound_rows(batch: pa.RecordBatch, items: Items, weights, documents: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, bag) of each document and its bounds."""
    m = length_norm(batch.column("n").to_numpy(), documents, length)
    found = bounds(batch.column("sketch").to_pylist(), batch.column("bits").to_numpy(), m, items, weights)
    return np.stack((batch.column("doc_id").to_numpy(), batch.column("bag").to_numpy()), axis=1), found


def _pair_batch(item: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item.astype(np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(bound.astype(np.int64))],
        names=["item", "doc_id", "bag", "bound"],
    )


def _highest(batches: Iterator[pa.RecordBatch], items: Items, weights, documents: int, length: int, first: int) -> Iterator[pa.RecordBatch]:
    """The highest bounds of each item among the documents of the task."""
    n = len(items.places)
    ids, best = np.zeros((0, n, 2), np.int64), np.zeros((0, n))
    for batch in batches:
        of, found = _bound_rows(batch, items, weights, documents, length)
        best = np.concatenate((best, found))
        ids = np.concatenate((ids, np.broadcast_to(of[:, None, :], (*found.shape, 2))))
        if len(best) > first:
            at = np.argpartition(-best, first - 1, axis=0)[:first]
            best, ids = np.take_along_axis(best, at, 0), np.take_along_axis(ids, at[:, :, None], 0)
    row, item = np.nonzero(best > 0)
    yield _pair_batch(item, ids[row, item], best[row, item])


def _reaching(batches: Iterator[pa.RecordBatch], items: Items, weights, documents: int, length: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every pair whose bound reaches its item's threshold."""
    for batch in batches:
        ids, found = _bound_rows(batch, items, weights, documents, length)
        row, item = np.nonzero(found >= least[None, :])
        yield _pair_batch(item, ids[row], found[row, item])


def _exact(batches: Iterator[pa.RecordBatch], items: Items, weights, documents: int, length: int) -> Iterator[pa.RecordBatch]:
    """Scores of each document for the items it is asked for."""
    value = np.zeros(len(items.terms), np.int64)
    for batch in batches:
        asked = batch.column("items")
        for i, j, offsets, data in text_chunks(batch.column("text")):
            doc, hashes, tf, n = terms_of(data, offsets)
            place, known = find(items.terms, hashes)
            doc, place, tf = doc[known], place[known], tf[known]
            m = length_norm(n, documents, length)
            impact = impacts(tf, m[doc]) * weights[place]
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            item, row, score = [], [], []
            for r in range(j - i):
                value[place[cuts[r] : cuts[r + 1]]] = impact[cuts[r] : cuts[r + 1]]
                for q in asked[i + r].as_py():
                    item.append(q)
                    row.append(r)
                    score.append(int((value[items.places[q]] * items.times[q]).sum()))
                value[place[cuts[r] : cuts[r + 1]]] = 0
            ids = batch.column("doc_id").slice(i, j - i).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def _block(texts: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items."""
    spark = texts.sparkSession
    made = materialise(texts.mapInArrow(partial(_sketches, items=items), _MADE), "ranked-sketches")
    total = made.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(total[0]), int(total[1])
    df = np.zeros(len(items.terms), np.int64)
    for term, n in made.filter("term is not null").groupBy("term").agg(F.sum("df")).collect():  # at most BLOCK_TERMS rows
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    told = {"items": items, "weights": weights, "documents": documents, "length": length}
    sketches = made.filter("n > 0 and doc_id is not null").select("doc_id", "n", "bag", "bits", "sketch")
    known = texts.filter("doc_id is not null")
    scores = spark.createDataFrame([], "item int, doc_id long, score long")

    def ranked() -> DataFrame:
        by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        return scores.filter("score > 0").withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)

    def least() -> DataFrame:
        """(item, least): score of the k-th best document, where there are so many."""
        return materialise(ranked().filter(F.col("rank") == k).select("item", F.col("score").alias("least")), "ranked-least")

    def highest(pairs: DataFrame, n: int) -> DataFrame:
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
        return pairs.withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= n).drop("r")

    def rescored(pairs: DataFrame) -> DataFrame:
        per = materialise(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "ranked-asked")
        few = per.count() <= IDS_SENT
        asked = known.join(F.broadcast(per) if few else per, "doc_id").select("doc_id", "text", "items")
        return materialise(asked.mapInArrow(partial(_exact, **told), "item int, doc_id long, score long"), "ranked-scores")

    def unscored(pairs: DataFrame) -> DataFrame:
        return pairs.join(scores.select("item", "doc_id").distinct(), ["item", "doc_id"], "left_anti")

    first = sketches.mapInArrow(partial(_highest, **told, first=FIRST), _PAIR)
    scores = rescored(highest(first, FIRST))
    limits = np.ones(len(items.places))
    for item, score in least().collect():  # at most one row an item
        limits[item] = score
    reaching = sketches.mapInArrow(partial(_reaching, **told, least=limits), _PAIR)
    # Documents with the same terms have the same score: only the k smallest of them can be found.
    same = Window.partitionBy("item", "bag").orderBy("doc_id")
    reaching = reaching.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k)
    left = materialise(unscored(reaching.select("item", "doc_id", "bound")), "ranked-reaching")
    scores = scores.unionByName(rescored(highest(left, SECOND)))
    left = unscored(left.join(F.broadcast(least()), "item", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(1))))
    scores = scores.unionByName(rescored(left))
    return ranked().select("item", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, offsets, data in text_chunks(batch.column("text")):
            doc, hashes, tf, _ = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(doc + i)), pa.array(hashes.view(np.int64)), pa.array(tf.astype(np.int64))],
                names=["item", "term", "times"],
            )


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """One row per item (item_id, text) and found document: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    named = materialise(named, "ranked-items")
    terms = materialise(named.mapInArrow(_item_terms, "item long, term long, times long"), "ranked-terms")
    # Consecutive items until a block is full: running sums of at most one row an item.
    counted = terms.groupBy("item").agg(F.count("*").alias("n")).orderBy("item").toLocalIterator()
    blocks, full = [[]], 0
    for item, n in counted:
        if full + n > BLOCK_TERMS and blocks[-1]:
            blocks.append([])
            full = 0
        blocks[-1].append(item)
        full += n
    found = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    for block in filter(None, blocks):
        rows = terms.filter(F.col("item").between(block[0], block[-1])).toArrow()
        item, term, times = (rows.column(c).to_numpy() for c in ("item", "term", "times"))
        distinct, place = np.unique(term.view(np.uint64), return_inverse=True)
        number = np.searchsorted(np.array(block), item)
        of = [np.flatnonzero(number == i) for i in range(len(block))]
        made = _block(texts, Items(distinct, tuple(place[x] for x in of), tuple(times[x] for x in of)), k)
        names = spark.createDataFrame(list(enumerate(block)), "number int, item long")
        found = found.union(
            made.join(F.broadcast(names.withColumnRenamed("number", "item_number")), made.item == F.col("item_number")).select(
                names.item, "rank", "doc_id", "score"
            )
        )
    return found.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
