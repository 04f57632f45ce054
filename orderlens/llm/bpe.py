"""Byte-level BPE: encode by corpus-level merge replay, decode by the vocabulary.

Ranks are a public file of base64 tokens and numbers (``load_ranks``). A text is
cut by the tokenizer's pattern; the distinct pieces of a chunk of documents form
one small corpus. ``Replay`` keeps an inverted index from rank to the places of
that pair in all pieces and applies the merges in rank order, each to all its
places from left to right, touching only the neighbours of a merged pair. Pieces
are independent of each other, so replaying the corpus chunk by chunk gives what
one replay over all of it would give, without a shuffle of the texts; pieces met
before are remembered per worker, in a memory of fixed size.

Defined results: NULL and empty texts have no ids. Pieces that are tokens
themselves are that token, as in the public library. Special tokens are ordinary
text. Bytes that are no UTF-8 are read as U+FFFD. Other columns are kept.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orderlens.llm.text import chunks, list_column, range_hashes, text_chunks
from orderlens.session import ship_package

DECODED = 1 << 19  # ids decoded at once
REMEMBERED = 600_000  # pieces a worker remembers, some 30 bytes each
LETTER, NUMBER, OTHER, BLANK = range(4)
# The endings that the public pattern cuts off behind an apostrophe.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")

_state: dict = {}


def load_ranks(spark, path: str) -> bytes:
    """The rank file as bytes: fixed size, sent to the tasks with the function."""
    if "://" in path:
        return spark.read.format("binaryFile").load(path).first()["content"]
    with open(path, "rb") as file:
        return file.read()


# --- cutting -----------------------------------------------------------------


def _kinds() -> np.ndarray:
    """Kind of every code point: letter, number, blank (Unicode White_Space) or other."""
    if "kinds" not in _state:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            first = unicodedata.category(chr(cp))[0]
            if first == "L":
                kinds[cp] = LETTER
            elif first == "N":
                kinds[cp] = NUMBER
            elif first == "Z":
                kinds[cp] = BLANK
        kinds[[*range(0x09, 0x0E), 0x20, 0x85]] = BLANK
        _state["kinds"] = kinds
    return _state["kinds"]


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pieces of the public pattern start in code points; ``borders`` are starts of documents.

    A piece is a run of one kind. A space before a run of letters, numbers or
    others belongs to it; of a longer blank run before text only the last blank is
    split off. A lone apostrophe takes one of the fixed endings from the letters
    behind it.
    """
    n = len(points)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[borders] = True
    edge[n] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = change[:n].copy()
    blank = kind == BLANK
    # The last blank of a run that is followed by text of the same document.
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    joined = last[points[last] == 0x20]
    start[joined + 1] = False
    # Endings behind an apostrophe that starts a piece and is a run of its own.
    quote = np.flatnonzero((points[: n - 1] == 0x27) & start[: n - 1] & change[1:n] & ~edge[1:n]) if n > 1 else []
    quote = quote[kind[quote + 1] == LETTER] if len(quote) else np.zeros(0, np.int64)
    if len(quote):
        after = np.full(n + 2, 0, np.uint32)
        after[:n] = points
        inside = ~edge[np.minimum(quote + 2, n)]
        one = np.isin(after[quote + 1], [ord(c) for c in ENDINGS_1])
        two = np.zeros(len(quote), bool)
        for x, y in ENDINGS_2:
            two |= (after[quote + 1] == ord(x)) & (after[quote + 2] == ord(y)) & inside
        for found, length in ((quote[one], 1), (quote[two & ~one], 2)):
            start[found + 1] = False
            beyond = found + 1 + length
            beyond = beyond[beyond < n]
            start[beyond] = True
            # a lone blank that now follows keeps its own start; letters behind start anew
    # A space that was joined to the run behind stays the start of that run.
    return np.flatnonzero(start)


# --- replay ------------------------------------------------------------------


class Vocabulary:
    """Tokens by number, numbers by token, and the number that each mergeable pair makes."""

    def __init__(self, ranks: bytes) -> None:
        self.number = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.token: dict[int, bytes] = {v: k for k, v in self.number.items()}
        self.bytes = np.array([self.number[bytes([i])] for i in range(256)], np.int64)
        self.made: dict[int, int] = {}
        for token, n in self.number.items():
            for cut in range(1, len(token)):
                a, b = self.number.get(token[:cut]), self.number.get(token[cut:])
                if a is not None and b is not None:
                    self.made[a << 20 | b] = n
        self.pairs = np.array(sorted(self.made), np.int64)
        self.pair_rank = np.array([self.made[p] for p in self.pairs.tolist()], np.int64)

    def _index(self, codes: np.ndarray, stops: np.ndarray) -> dict[int, list[int]]:
        """Rank of a pair of neighbours in one piece, and its places in order."""
        keys = codes[:-1] << 20 | codes[1:]
        keys[stops[:-1] - 1] = -1
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        place = np.flatnonzero(self.pairs[at] == keys)
        rank = self.pair_rank[at[place]]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        heads = rank[np.concatenate(([0], cuts))].tolist() if len(rank) else []
        places, cuts = place.tolist(), [0, *cuts.tolist(), len(place)]
        return {r: places[cuts[i] : cuts[i + 1]] for i, r in enumerate(heads)}

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece by merges in rank order over all pieces at once."""
        codes = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(codes)
        stops = np.cumsum([len(p) for p in pieces])
        link = np.arange(1, n + 1)
        link[stops - 1] = -1
        after = link.tolist()
        link = np.arange(-1, n - 1)
        link[stops[:-1]] = -1
        before = link.tolist()
        flat, ends = codes.tolist(), stops.tolist()
        made, index = self.made.get, self._index(codes, stops)
        queue = list(index)
        heapq.heapify(queue)
        odd: set[int] = set()
        while queue:
            rank = heapq.heappop(queue)
            for i in index.pop(rank):
                j = after[i]
                # Places whose pair has gone meanwhile are passed over.
                if j < 0 or flat[i] < 0 or made(flat[i] << 20 | flat[j]) != rank:
                    continue
                flat[i], flat[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    new = made(rank << 20 | flat[k])
                    if new is not None:
                        if new < rank:
                            odd.add(i)
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(queue, new)
                h = before[i]
                if h >= 0:
                    new = made(flat[h] << 20 | rank)
                    if new is not None:
                        if new < rank:
                            odd.add(h)
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(queue, new)
        out, first = [], 0
        for piece, end in zip(pieces, ends, strict=True):
            if odd and not odd.isdisjoint(range(first, end)):
                out.append(self.single(piece))
            else:
                out.append([t for t in flat[first:end] if t >= 0])
            first = end
        return out

    def single(self, piece: bytes) -> list[int]:
        """One piece alone, least rank first: for pairs whose merge makes an earlier rank."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        while len(ids) > 1:
            found = [(self.made.get(ids[i] << 20 | ids[i + 1], 1 << 60), i) for i in range(len(ids) - 1)]
            rank, i = min(found)
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [rank]
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        known = [self.number.get(p) for p in pieces]
        todo = [p for p, k in zip(pieces, known, strict=True) if k is None]
        replayed = iter(self.replay(todo) if todo else [])
        return [[k] if k is not None else next(replayed) for k in known]


class Memory:
    """Ids of pieces met before, by hash, in sorted arrays; emptied when it is full."""

    def __init__(self) -> None:
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes, and which of them are known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Hashes in order, none of them known."""
        if len(self.hashes) + len(hashes) > REMEMBERED and len(self.hashes):
            self.__init__()
        counts = np.array([len(x) for x in ids], np.int64)
        begin = len(self.flat) + np.cumsum(counts) - counts
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (
            np.insert(old, at, new)
            for old, new in ((self.hashes, hashes), (self.begin, begin), (self.count, counts))
        )
        self.flat = np.concatenate((self.flat, np.array([t for x in ids for t in x], np.int32)))


def _vocabulary(ranks: bytes) -> Vocabulary:
    key = (len(ranks), hash(ranks))
    if _state.get("key") != key:
        _state.update(key=key, vocabulary=Vocabulary(ranks), memory=Memory())
    return _state["vocabulary"]


def encode_chunk(vocabulary: Vocabulary, memory: Memory, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a chunk, one after another, and how many each has."""
    sizes = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return np.zeros(0, np.int32), sizes
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
    borders = np.searchsorted(at, offsets[:-1])
    start = at[piece_starts(points, borders[borders < len(points)])]
    end = np.append(start[1:], len(data))
    hashes = range_hashes(data, start, end)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    at, known = memory.find(distinct)
    if not known.all():
        raw = data.tobytes()
        size = end - start
        for again in (False, True):  # once more for all of them, if the memory was full and emptied
            new = first[~known]
            pieces = [raw[a : a + n] for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)]
            memory.add(distinct[~known], vocabulary.encode_pieces(pieces))
            at, known = memory.find(distinct)
            if known.all():
                break
    each = memory.count[at][inverse]
    ends = np.cumsum(each)
    places = np.arange(ends[-1]) + np.repeat(memory.begin[at][inverse] - (ends - each), each)
    documents = np.searchsorted(start, offsets)
    totals = np.concatenate(([0], ends))
    return memory.flat[places], totals[documents[1:]] - totals[documents[:-1]]


def _encode(batches: Iterator[pa.RecordBatch], ranks: bytes, text: int) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(ranks)
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column(text)):
            ids, counts = encode_chunk(vocabulary, _state["memory"], offsets, data)
            columns = [c.slice(i, j - i) for n, c in enumerate(batch.columns) if n != text]
            yield pa.RecordBatch.from_arrays(
                [*columns, list_column(ids, counts, pa.int32())],
                names=[str(n) for n in range(len(columns) + 1)],
            )


def _decode(batches: Iterator[pa.RecordBatch], ranks: bytes, ids: int) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(ranks)
    size = 1 + max(vocabulary.token)
    tokens = [vocabulary.token.get(i, b"") for i in range(size)]
    flat, length = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
    begin = np.cumsum(length) - length
    for batch in batches:
        lists = batch.column(ids)
        ends = lists.offsets.to_numpy().astype(np.int64)
        for i, j in chunks(ends, DECODED):
            these = np.frombuffer(lists.values.buffers()[1], np.int32)[lists.values.offset :][ends[i] : ends[j]]
            known = (these >= 0) & (these < size)
            each = np.where(known, length[np.where(known, these, 0)], 0)
            stops = np.concatenate(([0], np.cumsum(each)))
            places = np.arange(stops[-1]) + np.repeat(begin[np.where(known, these, 0)] - stops[:-1], each)
            raw = flat[places]
            borders = stops[ends[i : j + 1] - ends[i]].astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(borders), pa.py_buffer(raw)])
            columns = [c.slice(i, j - i) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, out], names=[str(n) for n in range(len(columns) + 1)])


def encode(df: DataFrame, ranks: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns but ``text``, and ``into`` array<int>: the ids of the whole text."""
    ship_package(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != text and f.name != into]
    df = df.select(*[F.col(f"`{f.name}`") for f in fields], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(into, T.ArrayType(T.IntegerType()))])
    made = df.mapInArrow(partial(_encode, ranks=ranks, text=len(fields)), _numbered(schema))
    return made.toDF(*schema.names)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns, and ``into`` binary: the bytes that the ids stand for; unknown ids stand for none."""
    ship_package(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != into and f.name != ids]
    df = df.select(*[F.col(f"`{f.name}`") for f in fields], F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids))
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(into, T.BinaryType())]
    )
    made = df.mapInArrow(partial(_decode, ranks=ranks, ids=len(fields)), _numbered(schema))
    return made.toDF(*schema.names)


def _numbered(schema: T.StructType) -> T.StructType:
    """The tasks return columns by place, so that clashing names do no harm."""
    return T.StructType([T.StructField(str(n), f.dataType) for n, f in enumerate(schema.fields)])


def with_digests(coded: DataFrame) -> DataFrame:
    """``coded`` with n_tokens, ids_sha256 and decoded_sha256."""
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    )
