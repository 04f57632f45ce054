"""Language ID by interpolated Kneser-Ney character models, one for each language.

Character 4-grams (letters lower-cased, everything else one blank) are counted over
all learning texts inside the tasks and summed by Spark. The models of orders 4 to
1 follow from the distinct 4-grams: the highest order has counts, lower orders have
the numbers of distinct left neighbours. They are kept as sorted arrays of hashed
grams with one log-probability a language; the tasks look every position of a text
up and take the language of least cross-entropy a character. Scores lie in (0, 1]:
the share of the best language if eight characters were judged. ``rejected`` is
set where the cross-entropy is above a limit of the predicted language, which a share
of ``REJECTED`` of its fresh texts exceeds. Limits are calibrated on one in
``CALIBRATION`` distinct learning texts, judged by models of the others; the models
that predict are then made from all learning texts. A rejected text keeps its lang_pred.

The model holds every 4-gram of every language, so discounts, totals and numbers of
neighbours are those of all learning texts. It is made on the driver and broadcast;
both grow with the distinct grams (times the languages), not with the texts. Code
points beyond 16 bits are folded to 16.

Defined results: a NULL text or one without a letter is ``und`` with score 0. With
nothing to learn from everything is ``und``. A NULL lang is not learnt from; lang,
source and doc_id are no inputs of a prediction. Texts equal in value get equal
predictions. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.text import U, mix
from orderlens.session import materialise, ship_package

ORDER = 4
HELD = 1 << 20  # distinct grams a counting task holds before it hands them on
REJECTED = 0.01  # share of fresh texts of a learnt language that may be rejected
CALIBRATION = 8  # one in so many distinct learning texts sets the limits of rejection
FEW = 200  # texts that a language needs there for a quantile of its own
JUDGED = 8
SLICE = 1 << 20  # code points handled at once
BLANK = 0x20

_state: dict = {}


def _letters() -> np.ndarray:
    """Each code point as a 16-bit letter in lower case, or a blank."""
    if "letters" not in _state:
        table = np.full(0x110000, BLANK, np.uint64)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low if low < 0x10000 else 0xE000 | (low & 0x0FFF)
        _state["letters"] = table
    return _state["letters"]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE code points, or one longer text."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= SLICE):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts as 64-bit numbers, how many each text has, and which texts hold a letter."""
    pad = " " * (ORDER - 1)
    joined = pad + "".join((t or "") + pad for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    unit = _letters()[points]
    sizes = np.array([len(t or "") for t in texts], np.int64)
    start = len(pad) + np.concatenate(([0], np.cumsum(sizes + len(pad))[:-1]))
    n = len(unit) - ORDER + 1
    gram = unit[:n].copy()
    for i in range(1, ORDER):
        gram = (gram << U(16)) | unit[i : i + n]
    # The gram that ends at p stands at p - 3; the blank behind a text counts, further blanks do not.
    used = np.zeros(len(unit) + 1, np.int64)
    used[start] += 1
    np.add.at(used, start + sizes + 1, -1)
    here = np.cumsum(used)[: len(unit)] > 0
    here[1:] &= ~((unit[1:] == BLANK) & (unit[:-1] == BLANK))
    kept = here[ORDER - 1 :]
    totals = np.concatenate(([0], np.cumsum(kept)))
    first = start - (ORDER - 1)
    counts = totals[np.minimum(first + sizes + 1, n)] - totals[first]
    is_letter = np.concatenate(([0], np.cumsum(unit != BLANK)))
    return gram[kept], counts, is_letter[start + sizes] - is_letter[start] > 0


# --- counting ----------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, c = _merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"]
            )

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for i, j in slices(texts):
            g, counts, _ = grams(texts[i:j])
            of = np.repeat(np.arange(i, j), counts)
            for lang in dict.fromkeys(langs[i:j]):
                distinct, c = np.unique(g[langs[of] == lang], return_counts=True)
                held.setdefault(lang, []).append((distinct, c.astype(np.int64)))
                size += len(distinct)
            if size > 2 * HELD:
                held = {k: [_merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    distinct, inverse = np.unique(g, return_inverse=True)
    return distinct, np.bincount(inverse, weights=c, minlength=len(distinct)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a language and a text."""
    ship_package(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- models ------------------------------------------------------------------


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


class _Single:
    """The model of one language: for each order its grams, and for each context its weight for the next order."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, alphabet: int) -> None:
        self.alphabet = alphabet
        self.orders = {}
        for order in range(ORDER, 0, -1):
            context = gram >> U(16)
            heads, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=n)
            kinds = np.bincount(inverse)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            own = np.maximum(n - discount, 0) / total[inverse]
            self.orders[order] = (gram, own, heads, discount * kinds / total)
            if order > 1:
                suffix = gram & U((1 << 16 * (order - 1)) - 1)
                gram, n = np.unique(suffix, return_counts=True)

    def weight(self, order: int, context: np.ndarray) -> np.ndarray:
        heads, weights = self.orders[order][2:]
        at, found = _find(heads, context)
        return np.where(found, weights[at] if len(weights) else 1.0, 1.0)

    def probability(self, order: int, gram: np.ndarray) -> np.ndarray:
        if not order:
            return np.full(len(gram), 1 / self.alphabet)
        keys, own = self.orders[order][:2]
        at, found = _find(keys, gram)
        lower = self.probability(order - 1, gram & U((1 << 16 * (order - 1)) - 1) if order > 1 else gram)
        return np.where(found, own[at], 0.0) + self.weight(order, gram >> U(16)) * lower


@dataclass
class Models:
    """Sorted hash arrays for all languages: grams with log2 probabilities, contexts with log2 weights."""

    langs: list[str]
    uniform: float
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def log2(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each gram's last character in each language."""
        if not order:
            return np.full((len(gram), len(self.langs)), self.uniform, np.float32)
        keys, values = self.grams[order]
        at, found = _find(keys, mix(gram))
        out = values[at]
        rest = np.flatnonzero(~found)
        if len(rest):
            lost = gram[rest]
            heads, weights = self.contexts[order]
            at, known = _find(heads, mix(lost >> U(16)))
            lower = self.log2(lost & U((1 << 16 * (order - 1)) - 1) if order > 1 else lost, order - 1)
            out[rest] = lower + np.where(known[:, None], weights[at], 0)
        return out


def fit(counts: DataFrame) -> Models | None:
    """Models from counted grams; None if there are none."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    every = counts.select(number.alias("lang"), "gram", "n").toArrow()
    of, gram, n = (every.column(c).to_numpy() for c in ("lang", "gram", "n"))
    gram = gram.view(np.uint64)
    alphabet = len(np.unique(gram & U(0xFFFF))) + 1
    single = []
    for i in range(1, len(langs) + 1):
        own = np.flatnonzero(of == i)
        own = own[np.argsort(gram[own])]
        single.append(_Single(gram[own], n[own], alphabet))
    models = Models(langs, float(-np.log2(alphabet)))

    def table(keys: list[np.ndarray], of) -> tuple[np.ndarray, np.ndarray]:
        union = np.unique(np.concatenate(keys))
        values = np.stack([np.log2(of(s, union)) for s in single], axis=1).astype(np.float32)
        hashed = mix(union)
        place = np.argsort(hashed)
        return hashed[place], values[place]

    for order in range(1, ORDER + 1):
        models.grams[order] = table([s.orders[order][0] for s in single], lambda s, g, o=order: s.probability(o, g))
        models.contexts[order] = table([s.orders[order][2] for s in single], lambda s, h, o=order: s.weight(o, h))
    return models


def judge(models: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and cross-entropy of each text; ``und``, 0 and NaN without a letter."""
    langs, scores, entropies = [], [], []
    for i, j in slices(texts):
        g, counts, lettered = grams(texts[i:j])
        sums = np.zeros((len(g) + 1, len(models.langs)))
        np.cumsum(models.log2(g), axis=0, out=sums[1:], dtype=np.float64)
        ends = np.cumsum(counts)
        bits = -(sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)[:, None]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2((least[:, None] - bits) * JUDGED).sum(axis=1)
        langs += [models.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        scores.append(np.where(lettered, share, 0.0))
        entropies.append(np.where(lettered, least, np.nan))
    return langs, np.concatenate(scores or [np.zeros(0)]), np.concatenate(entropies or [np.zeros(0)])


def predict(docs: DataFrame, models: Models | None, keep: list[str]) -> DataFrame:
    """Columns ``keep``, lang_pred, score and cross_entropy (NULL without a letter) of every row."""
    spark = docs.sparkSession
    if models is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"))
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores, bits = judge(shared.value, texts)
            rest = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)],
                names=[*keep, "lang_pred", "score", "cross_entropy"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shape = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "lang_pred string, score double, cross_entropy double"])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def calibration_fold(text: Column) -> Column:
    """One in CALIBRATION of the distinct texts; copies of a text fall on the same side."""
    return F.pmod(F.xxhash64(text.cast("string")), F.lit(CALIBRATION)) == 0


def limits(said: DataFrame, few: int = FEW) -> DataFrame:
    """(lang_pred, most): the cross-entropy that a share REJECTED of each language's fresh texts exceeds; one row a language.

    ``said`` has lang, lang_pred, cross_entropy and text_hash of texts that the models have not learnt; copies count
    once and only texts of the predicted language count. Languages with fewer than ``few`` texts get their mean times
    the pooled quotient of quantile and mean. The row with a NULL language is for those without any text.
    """
    fresh = said.filter("lang = lang_pred and cross_entropy is not null").select("lang_pred", "cross_entropy", "text_hash").distinct()
    fresh = materialise(fresh, "lang-fresh")
    quantile = lambda c: F.percentile_approx(c, F.lit(1 - REJECTED), F.lit(10_000))
    own = fresh.groupBy("lang_pred").agg(
        F.count("*").alias("texts"), F.avg("cross_entropy").alias("usual"), quantile(F.col("cross_entropy")).alias("exact")
    )
    own = materialise(own, "lang-usual")
    pooled = fresh.join(own, "lang_pred").agg(
        quantile(F.col("cross_entropy") / F.col("usual")).alias("factor"), F.avg("cross_entropy").alias("all_usual")
    )
    pooled = pooled.select("factor", (F.col("factor") * F.col("all_usual")).alias("all_most")).first()
    factor, every = F.lit(pooled.factor).cast("double"), F.lit(pooled.all_most).cast("double")
    most = F.when(F.col("texts") >= few, F.col("exact")).otherwise(F.col("usual") * factor)
    rest = own.limit(1).select(F.lit(None).cast("string").alias("lang_pred"), every.alias("most"))
    return own.select("lang_pred", most.alias("most")).unionByName(rest)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents not held out, predict all of them.

    doc_id, held_out, lang_pred, score, cross_entropy, rejected.
    """
    text = F.col("text").cast("string")
    docs = docs.select(
        "doc_id",
        text.alias("text"),
        F.col("lang").cast("string").alias("lang"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.xxhash64(text).alias("text_hash"),
    )
    learnt = docs.filter("not held_out and lang is not null and text is not null")
    fold = learnt.filter(calibration_fold(F.col("text")))
    rest = materialise(count_grams(learnt.filter(~calibration_fold(F.col("text")))), "lang-grams")
    every = rest.unionByName(count_grams(fold)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    every = materialise(every, "lang-grams")
    known = materialise(limits(predict(fold, fit(rest), ["lang", "text_hash"])), "lang-limits")
    most = {r.lang_pred: r.most for r in known.collect()}
    said = predict(docs, fit(every), ["doc_id", "held_out"])
    # One row a language, at most as many as the models hold.
    own = F.coalesce(*[F.when(F.col("lang_pred") == lang, F.lit(m)) for lang, m in most.items() if lang], F.lit(most.get(None)).cast("double"))
    return said.withColumn("rejected", F.coalesce(F.col("cross_entropy") > own, F.lit(False)))
