"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes (a space and the text): A is byte-level BPE of a
``tokenizers`` file, B a sentencepiece model that adds the space itself. Tokens of A
and B are linked where their byte ranges overlap; offsets where both end cut a text
into groups.

1. ``align`` cuts each text before a space that follows a visible character. Both
   tokenizers start a token there (checked against B's vocabulary; A's pattern cuts
   there always), so a unit's tokens, groups and links do not depend on what is around
   it, and each distinct unit is encoded and aligned once per worker memory.
2. Documents are dealt into blocks of at most 65,536 documents and some ``LINKS``
   links. In a block each id pair has bit planes: plane p holds the documents whose
   number of links with the pair has bit p. A plane is a bitmap, or the sorted places
   of its documents where that is shorter.
3. Counts of a pair: the planes of a block OR-merged and popcounted give its
   documents, the popcounts weighted by 2**p its links; sums over the blocks give the
   corpus. The highest count of each B id comes from these.
4. The postings return the counts: each block's planes, joined with the counts of their
   pairs, meet again by block and give each document its sums.

A row of postings is one pair in one block, so a very frequent pair has as many rows as
there are blocks, its counting is combined before the shuffle, and no task holds more
than a block.

Defined results: NULL and empty texts, and texts whose joined token bytes of either
tokenizer differ from the space and the text (also text that is no UTF-8), have no
tokens: zeros and ''. Names of special tokens inside texts are plain text. NULL and
repeated doc_ids are documents of their own. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.text import range_hashes, text_chunks
from orderlens.session import materialise, ship_package

LINKS = 1 << 21  # links of a block, or those of one document
BLOCK_DOCS = 1 << 16
CHUNK = 1 << 22  # bytes of text handled at once, or one document
REMEMBERED = 600_000  # units that a worker remembers
B_BITS = 17  # bits of a B id inside a pair

_ALIGNED = (
    "doc_id long, block long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, docs int, planes array<binary>"
)

_state: dict = {}


class Vocabulary:
    """Bytes and size of each token of one tokenizer; ids without bytes have size -1."""

    def __init__(self, tokens: dict[int, bytes], size: int) -> None:
        each = [tokens.get(i, b"") for i in range(size)]
        self.size = np.array([len(t) if i in tokens else -1 for i, t in enumerate(each)], np.int64)
        self.begin = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(size.sum()) + np.repeat(self.begin[ids] - (ends - size), size)]


class Tokenizers:
    """Both tokenizers, and what has been found out about units so far."""

    def __init__(self, a: bytes, b: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        byte_of = {c: i for i, c in _byte_letters().items()}
        letters = json.loads(a)["model"]["vocab"]
        n_a, n_b = 1 + max(letters.values()), self.b.get_piece_size()
        self.of_a = Vocabulary({i: bytes(byte_of[c] for c in t) for t, i in letters.items() if all(c in byte_of for c in t)}, n_a)
        pieces = {}
        self.whole = False  # a piece crosses the border of units: then a text is one unit
        for i in range(n_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                pieces[i] = piece.replace("▁", " ").encode()
                self.whole |= "▁" in piece.lstrip("▁")
        self.of_b = Vocabulary(pieces, n_b)
        # An id and what may stand behind it in the text of groups.
        self.names_a = np.array([f"{i}{c}" for c in ",|" for i in range(n_a)], object)
        self.names_b = np.array([f"{i}{c}" for c in ",;\n" for i in range(n_b)], object)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.right = np.zeros(0, bool)
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A and B, groups
        self.links = np.zeros(0, np.int64)  # pairs of all units, one after another
        self.ends = np.zeros(1, np.int64)
        self.texts: list[str] = []

    def look_up(self, units: list[bytes]) -> np.ndarray:
        """Numbers of distinct units; new ones are encoded and aligned."""
        new = [u for u in units if u not in self.number]
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = units
        if new:
            first = len(self.texts)
            self._learn(new)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
        return np.array([self.number[u] for u in units], np.int64)

    def _learn(self, units: list[bytes]) -> None:
        read = [u.decode(errors="replace") for u in units]
        coded_a = [x.ids for x in self.a.encode_batch(read, add_special_tokens=False)]
        coded_b = self.b.encode([t[1:] for t in read], num_threads=1)
        # A last blank is a unit of its own; of an empty text the library makes nothing.
        coded_b = [[self.b.piece_to_id("▁")] if t == " " else ids for t, ids in zip(read, coded_b, strict=True)]
        size = np.array([len(u) for u in units], np.int64)
        text = np.frombuffer(b"".join(units), np.uint8)
        right = np.ones(len(units), bool)
        flat = []
        for coded, of in ((coded_a, self.of_a), (coded_b, self.of_b)):
            count = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.int64, int(count.sum()))
            unit = np.repeat(np.arange(len(units)), count)
            right[unit[of.size[ids] < 0]] = False
            right &= np.bincount(unit, of.size[ids], len(units)).astype(np.int64) == size
            flat.append((ids, unit))
        same = right.copy()
        for (ids, unit), of in zip(flat, (self.of_a, self.of_b), strict=True):
            spelt = of.spell(ids[right[unit]])
            byte = np.repeat(right, size)
            differs = np.flatnonzero(spelt != text[byte])
            same[np.repeat(np.arange(len(units)), size)[byte][differs]] = False
        (a, unit_a), (b, unit_b) = [(ids[same[unit]], unit[same[unit]]) for ids, unit in flat]
        links, unit_of_link, groups, names = aligned(a, self.of_a.size[a], b, self.of_b.size[b], unit_b)
        n = len(units)
        sizes = np.stack([np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(groups, minlength=n)], axis=1)
        order, last_a, last_b = names
        shown = np.concatenate((self.names_a[a + last_a * len(self.of_a.size)], self.names_b[b + last_b * len(self.of_b.size)]))[order]
        parts = iter("".join(shown.tolist()).split("\n"))
        self.texts += [next(parts) if ok else "" for ok in same.tolist()]
        self.right = np.concatenate((self.right, same))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.links = np.concatenate((self.links, links))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.bincount(unit_of_link, minlength=n))))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [i for i in range(256) if i not in set(shown)]
    return {**{i: chr(i) for i in shown}, **{x: chr(0x100 + n) for n, x in enumerate(hidden)}}


def aligned(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, unit_b: np.ndarray) -> tuple:
    """Links and groups of two token sequences over the same bytes.

    Returns each link's pair as one number and its unit, the unit of each group, and for
    the text of the groups the order of all A then B tokens and what stands behind each:
    for A whether it ends a group, for B 0 inside, 1 at the end of a group, 2 of a unit.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    # A token meets the B tokens from the first that ends behind its start to the first that reaches its end.
    first = np.searchsorted(end_b, end_a - size_a, side="right")
    count = np.searchsorted(end_b, end_a, side="left") - first + 1
    stops = np.cumsum(count)
    met = np.arange(count.sum()) + np.repeat(first - (stops - count), count)
    links = np.repeat(a, count) << B_BITS | b[met]
    closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    group_a = np.cumsum(closes_a) - closes_a
    group_b = np.cumsum(closes_b) - closes_b
    order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
    ends_unit = np.append(unit_b[1:] != unit_b[:-1], True) if len(unit_b) else np.zeros(0, bool)
    return links, unit_b[met], unit_b[closes_b], (order, closes_a.astype(np.int64), closes_b.astype(np.int64) + ends_unit)


def _tokenizers(a: bytes, b: bytes) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = (hash(a), hash(b))
    if _state.get("key") != key:
        _state.update(key=key, tokenizers=Tokenizers(a, b))
    return _state["tokenizers"]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places of spaces behind a character that is certainly no white space of any kind."""
    space = np.flatnonzero(data[1:] == 0x20) + 1
    before = data[space - 1]
    sure = (before > 0x20) & (before < 0x7F)
    # Of longer characters, those that share two bytes with a Unicode space do not cut.
    wide = space[(before >= 0x80) & (space >= 3)]
    two, three = data[wide - 2], data[wide - 3]
    odd = (two == 0xC2) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
    odd |= (three == 0xE3) & (two == 0x80)
    return np.sort(np.concatenate((space[sure], wide[~odd])))


def _chunk(tokenizers: Tokenizers, offsets: np.ndarray, data: np.ndarray) -> tuple:
    """For each document of a chunk: tokens of A and B, groups, links, digest; pairs of all links and their documents."""
    n = len(offsets) - 1
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(n + 1)
    full = np.flatnonzero(np.diff(offsets) > 1)
    start = offsets[full]
    if not tokenizers.whole:
        inner = unit_starts(data)
        start = np.union1d(start, inner[~np.isin(inner, offsets)])
    end = np.append(start[1:], len(data))
    end = np.minimum(end, offsets[np.searchsorted(offsets, start, side="right")])  # empty documents have no unit
    doc = np.searchsorted(offsets, start, side="right") - 1
    hashes = range_hashes(data, start, end)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    units = tokenizers.look_up([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])[inverse]
    lost = np.zeros(n, bool)
    lost[doc[~tokenizers.right[units]]] = True
    kept = ~lost[doc]
    doc, units = doc[kept], units[kept]
    totals = np.stack([np.bincount(doc, tokenizers.sizes[units, c], n).astype(np.int64) for c in range(3)], axis=1)
    begin = tokenizers.ends[units]
    each = tokenizers.ends[units + 1] - begin
    stops = np.cumsum(each)
    pairs = tokenizers.links[np.arange(each.sum()) + np.repeat(begin - (stops - each), each)]
    of = np.repeat(doc, each)
    texts = tokenizers.texts
    borders = np.searchsorted(doc, np.arange(n + 1))
    used = units.tolist()
    digests = [
        hashlib.sha256(";".join([texts[u] for u in used[a:b]]).encode()).hexdigest() if b > a else ""
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)
    ]
    return totals, np.bincount(of, minlength=n).astype(np.int64), digests, pairs, of


# --- bitmaps -----------------------------------------------------------------


def planes_of(pairs: np.ndarray, place: np.ndarray, docs: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct pairs of a block, and their bit planes: places of documents as 16-bit numbers, or a bitmap if that is no longer."""
    posting, times = np.unique(pairs << 16 | place, return_counts=True)
    pair, place = posting >> 16, (posting & 0xFFFF).astype(np.uint16)
    distinct, first = np.unique(pair, return_index=True)
    row = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(pair))))
    planes: list[list[bytes]] = [[] for _ in range(len(distinct))]
    width = (docs + 7) // 8
    for p in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> p) & 1 == 1
        rows, places = row[has], place[has]
        cuts = np.searchsorted(rows, np.arange(len(distinct) + 1)).tolist()
        raw = places.tobytes()
        for r in range(len(distinct)):
            s, e = cuts[r], cuts[r + 1]
            if 2 * (e - s) < width:
                planes[r].append(raw[2 * s : 2 * e])
            else:
                bits = np.zeros(docs, bool)
                bits[places[s:e]] = True
                planes[r].append(np.packbits(bits, bitorder="little").tobytes())
    for of in planes:
        while of and not of[-1]:
            of.pop()
    return distinct, planes


def postings_of(planes: pa.ListArray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of links of every posting: the planes of a row OR-merged, with their weights added."""
    ends = planes.offsets.to_numpy().astype(np.int64)
    held = planes.flatten()
    size = np.diff(ends)
    row = np.repeat(np.arange(len(planes)), size)
    plane = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8) if len(held) and held.buffers()[2] is not None else np.zeros(0, np.uint8)
    length = np.diff(at)
    short = length < (docs[row] + 7) // 8
    listed = np.flatnonzero(short & (length > 0))
    count = length[listed] // 2
    stops = np.cumsum(count)
    byte = np.repeat(at[:-1][listed] - 2 * (stops - count), count) + 2 * np.arange(count.sum())
    places = [data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8]
    of = [np.repeat(listed, count)]
    for i in np.flatnonzero(~short).tolist():
        bits = np.flatnonzero(np.unpackbits(data[at[i] : at[i + 1]], bitorder="little"))
        places.append(bits)
        of.append(np.full(len(bits), i))
    of, places = np.concatenate(of), np.concatenate(places)
    posting, back = np.unique(row[of] << 16 | places, return_inverse=True)
    times = np.bincount(back, (1 << plane[of]).astype(np.float64), len(posting)).astype(np.int64)
    return posting >> 16, posting & 0xFFFF, times


# --- tasks -------------------------------------------------------------------


def _align(batches: Iterator[pa.RecordBatch], a: bytes, b: bytes) -> Iterator[pa.RecordBatch]:
    tokenizers = _tokenizers(a, b)
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "block")]
        + [("place", pa.int32())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("pair", pa.int64()), ("docs", pa.int32()), ("planes", pa.list_(pa.binary()))]
    )
    block = TaskContext.get().partitionId() << 32
    pairs, places, docs = [], [], 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def flush() -> Iterator[pa.RecordBatch]:
        distinct, planes = planes_of(np.concatenate(pairs), np.concatenate(places), docs)
        for s in range(0, len(distinct), 1 << 16):
            part = distinct[s : s + (1 << 16)]
            yield rows(
                len(part), block=pa.array(np.full(len(part), block)), pair=pa.array(part),
                docs=pa.array(np.full(len(part), docs)), planes=pa.array(planes[s : s + (1 << 16)], pa.list_(pa.binary())),
            )

    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text"), CHUNK):
            totals, n_links, digests, of_pairs, of = _chunk(tokenizers, offsets, data)
            if docs and (docs + j - i > BLOCK_DOCS or sum(map(len, pairs)) + len(of_pairs) > LINKS):
                yield from flush()
                block, pairs, places, docs = block + 1, [], [], 0
            yield rows(
                j - i, doc_id=batch.column("doc_id").slice(i, j - i), block=pa.array(np.full(j - i, block)),
                place=pa.array(docs + np.arange(j - i)), n_a=pa.array(totals[:, 0]), n_b=pa.array(totals[:, 1]),
                n_groups=pa.array(totals[:, 2]), n_links=pa.array(n_links), groups_sha256=pa.array(digests, pa.string()),
            )
            pairs.append(of_pairs)
            places.append(of + docs)
            docs += j - i
    if docs:
        yield from flush()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, _, times = postings_of(batch.column("planes"), batch.column("docs").to_numpy())
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("pair"),
                pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                pa.array(np.bincount(row, times, n).astype(np.int64)),
            ],
            names=["pair", "n_docs", "n_links"],
        )


def _scores(block: pa.Table, counted: pa.Table) -> pa.Table:
    """For each document of a block: links whose count is the best of their B id, and the sum of counts over its links.

    ``counted`` has the count of each (``linked``) pair of the block, in any order.
    """
    block = block.combine_chunks()
    planes = block.column("planes").chunk(0) if block.num_rows else pa.array([], pa.list_(pa.binary()))
    row, place, times = postings_of(planes, block.column("docs").to_numpy())
    known = counted.column("linked").to_numpy()
    order = np.argsort(known)
    at = order[np.searchsorted(known, block.column("pair").to_numpy(), sorter=order)]
    count, best = counted.column("count").to_numpy()[at], counted.column("best").to_numpy().astype(bool)[at]
    docs = int(block.column("docs")[0].as_py())
    total = np.zeros(docs, np.int64)
    np.add.at(total, place, times * count[row])
    n_best = np.bincount(place, times * best[row], docs).astype(np.int64)
    return pa.table(
        {
            "block": pa.array(np.full(docs, block.column("block")[0].as_py())),
            "place": pa.array(np.arange(docs, dtype=np.int32)),
            "n_best": pa.array(n_best),
            "count_sum": pa.array(total),
        }
    )


def read_file(spark, path: str) -> bytes:
    """A vocabulary file: fixed size, sent to the tasks with the function."""
    if "://" in path:
        return spark.read.format("binaryFile").load(path).first()["content"]
    with open(path, "rb") as file:
        return file.read()


def align(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Rows of documents (pair NULL) and of postings (block, pair, docs of the block, planes); written."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.mapInArrow(partial(_align, a=a, b=b), _ALIGNED), "crosstok-aligned")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best): documents and links of each id pair, and if no pair of its B id has more links."""
    postings = made.filter("pair is not null").select("pair", "docs", "planes")
    counted = postings.mapInArrow(_counts, "pair long, n_docs long, n_links long").groupBy("pair").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")
    )
    counted = materialise(
        counted.withColumns({"a": F.shiftright("pair", B_BITS), "b": F.col("pair").bitwiseAND((1 << B_BITS) - 1)}), "crosstok-counts"
    )
    most = counted.groupBy("b").agg(F.max("n_links").alias("most"))  # at most one row a B id
    return counted.join(F.broadcast(most), "b").withColumn("best", F.col("n_links") == F.col("most")).drop("most")


def alignment(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = align(docs, a, b)
    counts = pair_counts(made).select("pair", F.col("n_links").alias("count"), "best")
    postings = made.filter("pair is not null").select("block", "pair", "docs", "planes")
    # The counts travel to the blocks by their pairs; the planes, most of the bytes, are dealt once only.
    counted = postings.select(F.col("block").alias("of_block"), F.col("pair").alias("of_pair")).join(counts, F.col("of_pair") == F.col("pair"))
    counted = counted.select("of_block", F.col("of_pair").alias("linked"), "count", "best")
    scored = postings.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(
        _scores, "block long, place int, n_best long, count_sum long"
    )
    rows = made.filter("place is not null").select("doc_id", "block", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(scored, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
