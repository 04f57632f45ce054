"""Nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

1. Equal vectors are one node (its smallest id); a node remembers the ``MEMBERS`` smallest
   ids, which is all that ``k`` < MEMBERS results can need.
2. The graph starts from blocks of vectors on the same side of random hyperplanes. Then
   neighbours of neighbours meet: every node gathers its neighbours and up to
   ``REVERSE`` of those it is a neighbour of, compares them with each other and
   offers each a better one; the best ``DEGREE`` stay. It ends when few lists change.
   Vectors travel as 8-bit numbers; a hub is cut to REVERSE rows before the shuffle.
3. A query starts at its own neighbours and, round by round, opens the best ``OPEN``
   nodes not yet opened among the best ``BEAM``, for all queries at once, until all of these
   are opened. The best ``EXACT`` nodes are then compared on the original vectors in
   double precision.

The index holds every valid vector; it is approximate. Recall against brute force is
measured in tests/llm.

Defined results: vectors that are NULL, empty, zero, hold NULL or non-finite parts, or
differ in length from most of the others take no part, as queries or as candidates;
so does a NULL id. Ties go to the smaller id. Rows with one id and one vector are one; an id
with several vectors is one node for each, and found once with its best score. An
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from orderlens.session import materialise, ship_package

DEGREE = 24
REVERSE = 24
ROUNDS = 8
BLOCK = 2048
TREES = 10
BEAM = 96
OPEN = 32
EXACT = 24
MEMBERS = 6
SETTLED = 0.05  # share of list places that changed in the last round


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles, norm) of the rows that take part."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad)
    rows = rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0 and norm < double('infinity')")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0)).dropDuplicates(["vec_id", "vector"])


def _packed(vector: Column, norm: Column) -> Column:
    """Unit vector as float array, for the tasks."""
    return F.transform(vector, lambda x: (x / norm).cast("float"))


def _rows(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _code(batches: Iterator[pa.RecordBatch], bits: int, trees: int) -> Iterator[pa.RecordBatch]:
    """node, 8-bit vector and the block of each tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = _rows(batch.column("unit"))
        planes = np.random.default_rng(11).standard_normal((trees, max(bits, 1), unit.shape[1])).astype(np.float32)
        blocks = []
        for t in range(trees):
            side = (unit @ planes[t].T > 0)[:, :bits]
            blocks.append(side @ (1 << np.arange(bits)) if bits else np.zeros(len(unit), np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                pa.array([v.tobytes() for v in eight_bits(unit)], pa.binary()),
                pa.array(np.stack(blocks, axis=1).astype(np.int64).tolist(), pa.list_(pa.int64())),
            ],
            names=["node", "code", "blocks"],
        )


def eight_bits(unit: np.ndarray) -> np.ndarray:
    """Whole numbers up to 127, scaled by the largest part of each vector."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def _units(codes: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return part


def _block_lists(key: tuple, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one block for each of its nodes."""
    nodes, x = rows["node"].to_numpy(), _units(rows["code"].tolist())
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = _best(sims, k)
    a = np.repeat(nodes, best.shape[1])
    s = np.take_along_axis(sims, best, 1).ravel()
    out = pd.DataFrame({"node": a, "near": nodes[best].ravel(), "sim": s})
    return out[out["sim"] > -1.5]


def _codes(column: pa.Array) -> np.ndarray:
    """A column of equally long 8-bit vectors as unit vectors."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(data, np.int8)[ends[0] : ends[-1]].reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a neighbourhood compared with each other; offers better than their worst."""
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lists = batch.column("members")
        ends = lists.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        flat = lists.flatten()
        if not len(flat):
            continue
        every = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("near", "new", "worst")}
        units = _codes(flat.field("code"))
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            ids, new, worst = (every[c][s:e] for c in ("near", "new", "worst"))
            sims = units[s:e] @ units[s:e].T
            better = (sims > worst[:, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            found.append((ids[i], ids[j], sims[i, j]))
        if found:
            a, b, s = (np.concatenate([f[c] for f in found]) for c in range(3))
            # One row of a pair, and the best DEGREE offers of a node, from each batch.
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, s = a[fresh], b[fresh], s[fresh]
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            keep = rank < DEGREE
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep].astype(np.float32))], names=["node", "near", "sim"])


def _top(edges: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("node").orderBy(F.desc("sim"), "near")
    return edges.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)


def build_graph(codes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(node, near, sim, ...): the best ``degree`` found for each node. ``codes`` has node, code, blocks."""
    start = codes.select("node", "code", F.posexplode("blocks").alias("tree", "block"))
    sizes = materialise(start.groupBy("tree", "block").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "ann-blocks")
    dealt = start.join(sizes, ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    lists = dealt.groupBy("tree", "block", "part").applyInPandas(
        partial(_block_lists, k=degree), "node long, near long, sim float"
    )
    graph = _top(lists.groupBy("node", "near").agg(F.max("sim").alias("sim")), degree)
    graph = materialise(graph.select("node", "near", "sim", F.lit(True).alias("new")), "ann-graph")
    n = codes.count()
    for _ in range(rounds):
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        known = codes.select("node", "code").join(worst, "node", "left").select(
            F.col("node").alias("near"), "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst")
        )
        back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "new")
        by = Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64("node", "near"))
        back = back.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= REVERSE).drop("r")
        meeting = graph.select("node", "near", "new").unionByName(back).groupBy("node", "near").agg(F.max("new").alias("new"))
        groups = meeting.join(known, "near").groupBy("node").agg(F.collect_list(F.struct("near", "new", "worst", "code")).alias("members"))
        offers = groups.select("members").mapInArrow(_local_join, "node long, near long, sim float")
        old = graph.select("node", "near", "sim", F.lit(False).alias("new"))
        merged = (
            old.unionByName(offers.withColumn("new", F.lit(True)))
            .groupBy("node", "near")
            .agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        )
        graph = materialise(_top(merged, degree).drop("r"), "ann-graph")
        if graph.filter("new").count() <= SETTLED * n * degree:
            break
    return graph


def _step(batches: Iterator[pa.RecordBatch], beam: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Take the newly seen nodes in and choose the next ones to open."""
    kinds = [pa.int64(), pa.binary(), *[pa.list_(t) for t in (pa.int64(), pa.float32(), pa.bool_(), pa.int64(), pa.int64())]]
    names = ["query", "code", "ids", "sims", "opened", "seen", "todo"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ids, sims = np.array(r["ids"], np.int64), np.array(r["sims"], np.float32)
            opened, seen = np.array(r["opened"], bool), np.array(r["seen"], np.int64)
            opened |= np.isin(ids, np.array(r["todo"], np.int64))
            met = r["met"] or []
            new = np.array([m["near"] for m in met], np.int64)
            fresh = np.flatnonzero(~np.isin(new, seen))
            if len(fresh):
                x = _units([met[i]["code"] for i in fresh])
                ids = np.concatenate((ids, new[fresh]))
                sims = np.concatenate((sims, x @ _units([r["code"]])[0]))
                opened = np.concatenate((opened, np.zeros(len(fresh), bool)))
                seen = np.concatenate((seen, new[fresh]))
            best = np.lexsort((ids, -sims))[:beam]
            ids, sims, opened = ids[best], sims[best], opened[best]
            todo = ids[~opened][:at_once]
            rows.append((r["query"], r["code"], ids.tolist(), sims.tolist(), opened.tolist(), seen.tolist(), todo.tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def search(codes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, at_once: int = OPEN) -> DataFrame:
    """(query, near): the best nodes that each query node finds, itself among them."""
    by = Window.partitionBy("node").orderBy(F.desc("sim"), "near")
    back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "sim")
    back = back.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= REVERSE).drop("r")
    links = materialise(
        graph.select("node", "near").union(back.select("node", "near")).groupBy("node").agg(F.collect_set("near").alias("nears")),
        "ann-links",
    )
    known = codes.select(F.col("node").alias("near"), "code")
    state = queries.join(codes.select("node", "code"), F.col("query") == F.col("node")).select(
        "query", "code", F.array("query").alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"),
        F.array(F.lit(False)).alias("opened"), F.array("query").alias("seen"), F.array("query").alias("todo"),
    )
    state = materialise(state, "ann-state")
    shape = "query long, code binary, ids array<long>, sims array<float>, opened array<boolean>, seen array<long>, todo array<long>"
    while True:
        front = state.select("query", F.explode("todo").alias("node"))
        if front.isEmpty():
            break
        met = front.join(links, "node").select("query", F.explode("nears").alias("near")).distinct()
        met = met.join(known, "near").groupBy("query").agg(F.collect_list(F.struct("near", "code")).alias("met"))
        state = materialise(state.join(met, "query", "left").mapInArrow(partial(_step, beam=beam, at_once=at_once), shape), "ann-state")
    return state.select("query", F.explode(F.slice("ids", 1, EXACT)).alias("near"))


def _cosine(a: str, b: str, norm_a: str, norm_b: str) -> Column:
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return product / (F.col(norm_a) * F.col(norm_b))


def nearest(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``."""
    ship_package(table.sparkSession)
    rows = materialise(valid_vectors(table), "ann-rows")
    by = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= max(MEMBERS, k + 1))
    members = materialise(
        ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("norm").alias("norm")).withColumn(
            "node", F.xxhash64(F.col("ids")[0], "vector")
        ),
        "ann-nodes",
    )
    n = members.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    codes = members.select("node", _packed(F.col("vector"), F.col("norm")).alias("unit")).mapInArrow(
        partial(_code, bits=bits, trees=TREES), "node long, code binary, blocks array<long>"
    )
    codes = materialise(codes, "ann-codes")
    graph = build_graph(codes)
    asked = rows.filter(F.col("vec_id") % every == 0).join(members.select("vector", "node"), "vector").select("vec_id", "node")
    asked = materialise(asked, "ann-queries")
    found = search(codes, graph, asked.select(F.col("node").alias("query")).distinct())
    pairs = found.join(members.select(F.col("node").alias("query"), F.col("vector").alias("qv"), F.col("norm").alias("qn")), "query")
    pairs = pairs.join(members.select(F.col("node").alias("near"), "vector", "norm", "ids"), "near")
    scored = pairs.select("query", _cosine("qv", "vector", "qn", "norm").alias("score"), F.explode("ids").alias("vec_id"))
    every_one = (
        asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
        .join(scored, "query")
        .filter("query_id != vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
