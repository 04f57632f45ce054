"""Quality classifier with host and path evidence: hierarchical empirical Bayes.

A logistic regression on surface features gives each document its own log-odds. It
is fitted on at most ``TRAIN_ROWS`` labelled documents (chosen by hash of the id).
Everything else covers all documents: expected good documents are summed by path
and by host, with their squares; the spread between hosts, and between the paths of a
host, beyond what the scatter of their documents explains gives the strength of the
prior, so that sparse sites shrink to the global rate and sparse paths to their host. A
document's odds are multiplied by its path's posterior odds, without its own part in
path and host, over the global odds.

Defined results: a NULL host or path is a site of its own. NULL and empty texts
have all features 0. A document is rejected where the probability is below
``CUT``; without labels of both kinds nothing is rejected and all probabilities are
NULL. Several labels of one document count as its mean, rounded. Rows with one
doc_id are judged each by its text; ``keep_good`` drops all of them if one is
rejected. A NULL doc_id is judged like any other and never dropped. An empty table gives
no rows. Further columns are not read by the classifier and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.text import apart, shingle_hashes, text_chunks, word_hashes
from orderlens.session import materialise, ship_package

TRAIN_ROWS = 20_000
CUT = 0.5
FEATURES = 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#$%&*|=<>@^~{}[]_+\\/")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x FEATURES: shares of kinds of bytes, of repeated words and word pairs, and sizes."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    size = np.maximum(np.diff(offsets), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[data])))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    letters = np.maximum(share(_LETTER), 1)
    out[:, 0] = share(_UPPER) / letters
    out[:, 1] = np.sqrt(share(_SIGN) / size)
    out[:, 2] = np.sqrt(share(_BANG) / size)
    out[:, 3] = share(_DIGIT) / size
    hashes, first = word_hashes(data, offsets)
    count = np.diff(first)
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], hashes[1:] == hashes[:-1]))))) if len(hashes) else np.zeros(1, int)
    pairs = shingle_hashes(hashes, 2)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > 1:
            out[d, 4] = (same[b] - same[a + 1]) / (b - a - 1)
            out[d, 5] = 1 - len(np.unique(pairs[a : b - 1])) / (b - a - 1)
            out[d, 6] = len(np.unique(hashes[a:b])) / (b - a)
    out[:, 7] = np.log1p(count)
    out[:, 8] = np.log1p(np.diff(offsets) / np.maximum(count, 1))
    out[:, 9] = (out[:, 0] > 0.5) * 1.0
    return out


@dataclass(frozen=True)
class Classifier:
    """Standardised features times weights; the last weight is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -15, 15)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Classifier:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text")):
            x = features(data, offsets)
            columns = [batch.column("y").slice(i, j - i), *[pa.array(x[:, c]) for c in range(FEATURES)]]
            yield pa.RecordBatch.from_arrays(columns, names=["y", *[f"f{c}" for c in range(FEATURES)]])


def _score(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, offsets, data in text_chunks(batch.column("text")):
            odds = model.log_odds(features(data, offsets))
            rest = [batch.column(c).slice(i, j - i) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(odds)], names=["doc_id", "host", "path", "log_odds"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier of ``target`` from at most about ``rows`` labelled documents; None without both kinds."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    n = known.count()
    part = min(1.0, rows / max(n, 1))
    chosen = (
        known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
        .groupBy("doc_id")
        .agg(F.round(F.avg(target)).alias("y"))
    )
    # At most about ``rows`` rows of two numbers, whatever the size of the tables.
    joined = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    shape = "y double, " + ", ".join(f"f{c} double" for c in range(FEATURES))
    found = joined.select("y", "text").mapInArrow(_features, shape).toPandas().to_numpy(float)
    found = found[np.lexsort(found.T)] if len(found) else found
    if len(found) == 0 or len(np.unique(found[:, 0])) < 2:
        return None
    return fit_logistic(found[:, 1:], found[:, 0])


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


MOST_PULL = 1e6  # documents; the strength of a prior when sites do not differ at all


def _strength(groups: DataFrame, center: str) -> float:
    """Prior strength in documents, by moments: variance inside groups over the variance between them.

    ``groups`` have n, good (sum of p), squares (sum of p * p) and ``center``. The
    spread of the group means around their centers is what the groups differ by, plus
    what the scatter of their documents explains; that scatter is measured, not taken
    from draws of 0 and 1, because p are probabilities.
    """
    mean = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * (mean - F.col(center)) ** 2).alias("spread"),
        F.sum(F.col("squares") - F.col("n") * mean**2).alias("inner"),
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
    ).first()
    if not row["n"] or row["n"] <= row["groups"]:
        return 1.0
    inside = max(row["inner"], 0.0) / (row["n"] - row["groups"])
    between = max(row["spread"] - row["groups"] * inside, 0.0) / row["n"]
    return float(min(max(inside / between, 1.0), MOST_PULL)) if between > 0 else MOST_PULL


def posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, good, host_n, host_good), the global rate, and the strengths of the priors of hosts and paths.

    ``scored`` has host, path and p, the probability of each document.
    """
    sums = [F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = materialise(scored.groupBy("host", "path").agg(*sums), "site-paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = (total[0] or 0.0) / max(total[1] or 0, 1)
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "squares")]).withColumn("rate", F.lit(rate))
    hosts = materialise(hosts, "site-hosts")
    pull = _strength(hosts, "rate")
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    host_rate = (F.col("host_good") + F.lit(pull) * F.lit(rate)) / (F.col("host_n") + F.lit(pull))
    paths = materialise(paths.withColumn("host_rate", host_rate), "site-rates")
    return paths.drop("squares", "host_rate"), rate, pull, _strength(paths, "host_rate")


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, cut: float = CUT) -> DataFrame:
    """doc_id, host, path, p_document, host_rate, path_rate, p_quality and keep of every row; written."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    model = fit(docs, labels)
    none = F.lit(None).cast("double")
    if model is None:
        return docs.select(
            "doc_id", "host", "path", none.alias("p_document"), none.alias("host_rate"), none.alias("path_rate"),
            none.alias("p_quality"), F.lit(True).alias("keep"),
        )
    scored = docs.mapInArrow(partial(_score, model=model), "doc_id long, host string, path string, log_odds double")
    scored = materialise(scored.withColumn("p", 1 / (1 + F.exp(-F.col("log_odds")))), "quality-scores")
    sites, rate, host_pull, pull = posteriors(scored)
    sites = sites.toDF("h", "q", "n", "good", "host_n", "host_good")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # Without the document's own part, in the host as in the path.
    host_rate = (F.col("host_good") - F.col("p") + F.lit(host_pull * rate)) / (F.col("host_n") - 1 + F.lit(host_pull))
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("good") - F.col("p") + F.lit(pull) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(pull))
    joined = joined.withColumn("path_rate", path_rate)
    odds = F.col("log_odds") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    return materialise(
        joined.withColumn("p_quality", 1 / (1 + F.exp(-odds))).select(
            "doc_id",
            "host",
            "path",
            F.col("p").alias("p_document"),
            "host_rate",
            "path_rate",
            "p_quality",
            (F.col("p_quality") >= cut).alias("keep"),
        ),
        "quality-judged",
    )


def source_path() -> Column:
    """Path of a document of the synthetic table: its source and language."""
    return F.concat_ws("/", F.col("source"), F.col("lang"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, cut: float = CUT) -> DataFrame:
    """The documents that are not rejected, all columns."""
    gone = judge(docs, labels, host, path, cut).filter("not keep").select("doc_id").distinct()
    gone = materialise(gone, "gone")
    stay, asked = apart(docs, "doc_id", gone, "doc_id")
    return stay.unionByName(asked.join(gone, "doc_id", "left_anti").select(*docs.columns))
