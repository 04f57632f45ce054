"""Text columns as flat byte arrays, and 64-bit hashes of byte ranges, words and shingles.

All functions run inside Arrow tasks on chunks of whole documents; nothing here
holds more than one chunk (``CHUNK`` bytes, or one document if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 1 << 20

U = np.uint64
_SEED = np.random.default_rng(20240611)
_STEP = U(0xD6E8FEB86659FD93)
_SPREAD = U(0x9E3779B97F4A7C15)
SHORT = 16  # bytes that fit into two machine words
_SEEDS = _SEED.integers(1, 1 << 63, (2, 2), dtype=np.uint64)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a text column; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets, bytes) for each chunk of a text column."""
    offsets, data = column_bytes(column)
    for i, j in chunks(offsets, limit):
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes give equal hashes. Lane 1 is another hash.

    Ranges of up to 16 bytes are read as two machine words and scrambled; longer
    ones go through xxh3. Neither is a polynomial, for which clashes can be built.
    """
    size = end - start
    padded = np.zeros(len(data) + SHORT, np.uint8)
    padded[: len(data)] = data
    word = np.ndarray(len(data) + SHORT - 7, "<u8", padded, strides=(1,))
    low = word[start] & _FIRST[np.minimum(size, 8)]
    high = word[np.minimum(start + 8, len(word) - 1)] & _FIRST[np.clip(size - 8, 0, 8)]
    found = mix(mix(low ^ _SEEDS[lane][0]) * _SPREAD + (high ^ _SEEDS[lane][1]) + size.astype(np.uint64) * _STEP)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw, digest = memoryview(padded), xxhash.xxh3_64_intdigest
        ranges = zip(start[long].tolist(), end[long].tolist(), strict=True)
        found[long] = np.fromiter((digest(raw[a:b], lane) for a, b in ranges), np.uint64, len(long))
    return found


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each document (n + 1).

    Words are runs of bytes that are not ``outside`` (a flag for each byte).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start, end = inside & border[:-1], inside & border[1:]
    start[1:] |= inside[1:] & ~inside[:-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    start[0], end[-1] = inside[0], inside[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and the first word of each document (n + 1)."""
    s, e, first = words(data, offsets)
    return (range_hashes(LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)), first


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = mix(hashes[:n] + _STEP)
    for i in range(1, k):
        found = mix(found * _SPREAD + hashes[i : i + n])
    return found


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """As shingle_hashes for long windows, other values: put together from windows of 1, 2, 4, ... words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found, at, size, part = np.full(n, U(k)), 0, 1, hashes
    while size <= k:
        if k & size:
            found = mix(found * _SPREAD + part[at : at + n])
            at += size
        part = mix(part[:-size] * _SPREAD + part[size:] + _STEP) if len(part) > size else part[:0]
        size *= 2
    return found


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each document; fewer words make one shingle, none make none."""
    hashes, first = word_hashes(data, offsets)
    all_of = shingle_hashes(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(all_of[a : b - k + 1])
        elif b > a:
            yield shingle_hashes(hashes[a:b], b - a) ^ U(b - a)
        else:
            yield np.zeros(0, np.uint64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def words_of(text: Column) -> Column:
    """Lower-cased words as an array column, on the JVM; NULL and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


FILTER_BITS = 23


def apart(docs: DataFrame, key: str, chosen: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose ``key`` is certainly not in the column ``name`` of ``chosen``, and all others.

    Only the others need a join with ``chosen``, so most texts are not shuffled for a decision on few of them.
    The filter has one bit a hash and a fixed size; with more keys than bits it lets more rows through, never fewer.
    It is sent to all tasks whatever the broadcast threshold: 2**(FILTER_BITS - 6) rows of two numbers, 2 MB at most.
    """

    def at(c: str) -> tuple[Column, Column]:
        slot = F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
        return F.shiftright(slot, 6), bit

    word, bit = at(name)
    words = chosen.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = at(key)
    tested = docs.join(F.broadcast(words), word == F.col("__word"), "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return tested.filter(~maybe).select(*columns), tested.filter(maybe).select(*columns)
