"""Mixing to target weights with soft membership, by built-in functions only.

1. A naive Bayes classifier of words, fitted on at most ``TRAIN_ROWS`` labelled
   documents (by hash of the id), gives every document a posterior over domains.
   Terms whose counts depart most from chance have weights, one term in each of
   ``SLOTS`` slots; they are a constant table inside the plan.
2. Rates r >= 0 (and <= ``max_rate``) minimise the squared distance between the
   domains' expected tokens, sum of r * tokens * posterior, and their targets, by
   projected gradient from r = 1. Posteriors are whole ``GRID``ths, so documents are
   first added up by posterior; every step is one aggregate over these few rows. A
   rate is an expression of the residuals so far. Targets out of reach end at the
   nearest totals, with a warning.

Defined results: NULL and empty texts have 0 tokens and the prior as posterior. A
document without a usable label is not learnt from; without any the prior is even.
A NULL doc_id is mixed like any other. ``copies`` is the rate rounded up or down by
a hash of doc_id and text. Rows are mixed each for itself. An empty table gives no
rows. Further columns of documents are not read by ``mix_documents``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.text import apart, words_of
from orderlens.session import materialise

DOMAINS = ("good", "toxic", "poor")
TRAIN_ROWS = 10_000
SLOTS = 1 << 13
CHANCE = 60.0  # chi-square of a term that has weight
PSEUDO = 2.0
STEPS = 100
LOOK_BACK = 10
GRID = 1024  # posteriors are whole parts of it


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a row of the labelled table; NULL if the labels do not tell."""
    return (
        F.when(F.col(quality) == 0, F.lit("poor")).when(F.col(toxic) == 1, F.lit("toxic")).when(F.col(quality) == 1, F.lit("good"))
    )


def terms_of(text: Column, words: Column) -> Column:
    """Distinct words as hashes; 1 to 3 tell how a text looks: capitals only, few distinct words, many signs."""
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(words)
    signs = F.char_length(text) - F.char_length(F.translate(text, "|!#$%&*", ""))
    looks = [
        (F.char_length(text) > 0) & (text == F.upper(text)),
        (n > 20) & (F.size(hashes) < n * 0.5),
        signs > n * 0.3,
    ]
    none = F.array().cast("array<bigint>")
    return F.concat(hashes, *[F.when(x, F.array(F.lit(1 + i).cast("long"))).otherwise(none) for i, x in enumerate(looks)])


def _slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def _table(values: list, kind: str) -> Column:
    """A constant array of numbers, made by the optimiser from one text."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class Classifier:
    """Log-prior of each domain; by slot the term kept there and its weight for each domain."""

    prior: list[float]
    terms: list[int]
    weights: list[list[float]]
    scale: float = 1.0


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Weights of the terms whose counts depart most from chance, one a slot."""
    known = labels.select("doc_id", domain_of().alias("domain")).filter("doc_id is not null and domain is not null")
    part = min(1.0, rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).dropDuplicates(["doc_id"])
    # At most about ``rows`` rows of an id and a short name.
    learnt = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("words", words_of(F.col("text")))
    terms = learnt.select("domain", F.explode(terms_of(F.col("text"), F.col("words"))).alias("term"))
    found = {r["domain"]: r["count"] for r in learnt.groupBy("domain").count().collect()}
    sizes = [found.get(d, 0) for d in DOMAINS]
    total = max(sum(sizes), 1)
    n = F.col("n")
    counted = terms.groupBy("term").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    )
    expected = [n * F.lit(max(size / total, 1e-9)) for size in sizes]
    chance = F.greatest(*[(F.col(d) - e) * (F.col(d) - e) / e for d, e in zip(DOMAINS, expected, strict=True)])
    heavy = (
        counted.filter(n > 3)
        .withColumn("chance", chance)
        .filter(F.col("chance") > CHANCE)
        .groupBy(_slot(F.col("term")).alias("slot"))
        .agg(F.max(F.struct("chance", "term", "n", *DOMAINS)).alias("t"))
    )
    by_slot = [0] * SLOTS
    weights = [[0.0] * SLOTS for _ in DOMAINS]
    for slot, t in heavy.collect():  # at most SLOTS rows
        by_slot[slot] = t["term"]
        for d, name in enumerate(DOMAINS):
            # PSEUDO further documents, dealt as the domains are, pull a term's shares to the usual ones.
            share = max(sizes[d] / total, 1e-9)
            odds = (t[name] + PSEUDO * share) / ((t["n"] + PSEUDO) * share)
            weights[d][slot] = round(float(np.clip(np.log(odds), -4, 4)), 3)
    raw = Classifier([0.0] * len(DOMAINS), by_slot, weights)
    seen = _scores(learnt.select("domain", "text"), raw).select("domain", *[f"__s_{n}" for n in DOMAINS]).collect()  # at most about ``rows``
    return calibrated(raw, np.array([r[1:] for r in seen], float).reshape(-1, len(DOMAINS)), [DOMAINS.index(r[0]) for r in seen])


def calibrated(model: Classifier, sums: np.ndarray, domain: list[int], steps: int = 2000) -> Classifier:
    """Scale and priors that make the posteriors of the learning rows fit: words of a text are not independent."""
    size = len(DOMAINS)
    if not len(sums):
        return Classifier([float(-np.log(size))] * size, model.terms, model.weights)
    sure = np.eye(size)[domain]
    prior, scale = np.log((sure.sum(axis=0) + 1) / (len(sums) + size)), 0.5
    spread = max(float((sums**2).mean()), 1e-9)
    for _ in range(steps):
        z = prior + scale * sums
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = p / p.sum(axis=1, keepdims=True) - sure
        prior = prior - off.mean(axis=0)
        scale = max(0.0, scale - 0.3 * float((off * sums).sum(axis=1).mean()) / spread)
    return Classifier([round(float(v), 6) for v in prior], model.terms, model.weights, round(scale, 6))


def _sum_of(slots: str, table: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda total, s: total + F.get(table, s))


def _scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with tokens and the logarithm __s_{domain} of what each posterior is proportional to."""
    out = docs.withColumn("__words", words_of(F.col("text").cast("string")))
    out = out.withColumn("tokens", F.size("__words").cast("long"))
    terms = _table(model.terms, "bigint")
    out = out.withColumn("__terms", terms_of(F.col("text"), F.col("__words"))).drop("__words")
    kept = F.filter("__terms", lambda t: F.get(terms, _slot(t)) == t)
    out = out.withColumn("__slots", F.transform(kept, _slot)).drop("__terms")
    sums = {
        f"__s_{name}": F.lit(model.prior[d]) + F.lit(model.scale) * _sum_of("__slots", _table(model.weights[d], "double"))
        for d, name in enumerate(DOMAINS)
    }
    return out.withColumns(sums).drop("__slots")


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with tokens and p_{domain}."""
    out = _scores(docs, model)
    most = F.greatest(*[F.col(f"__s_{n}") for n in DOMAINS])
    out = out.withColumns({f"__e_{n}": F.exp(F.col(f"__s_{n}") - most) for n in DOMAINS})
    total = sum(F.col(f"__e_{n}") for n in DOMAINS)
    out = out.withColumns({f"p_{n}": F.col(f"__e_{n}") / total for n in DOMAINS})
    return out.drop(*[f"__{x}_{n}" for n in DOMAINS for x in "se"])


def _dot(values: np.ndarray) -> Column:
    return sum(F.col(f"p_{n}") * F.lit(float(v)) for n, v in zip(DOMAINS, values, strict=True))


def _cells(member: DataFrame) -> DataFrame:
    """Tokens of equal posteriors added up: at most (GRID + 1)(GRID + 2) / 2 rows, however many documents there are."""
    p = [f"p_{n}" for n in DOMAINS]
    return materialise(member.groupBy(*p).agg(F.sum("tokens").alias("tokens")), "mix-cells")


def _clip(rate: Column, max_rate: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), rate)
    return rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)


def _walk(moves: list[np.ndarray], max_rate: float | None) -> Column:
    """The rate after ``moves`` from 1, as one loop over constant arrays, so that it stays short."""
    if not moves:
        return F.lit(1.0) if max_rate is None else F.lit(min(1.0, float(max_rate)))
    tables = [_table([float(m[d]) for m in moves], "double") for d in range(len(DOMAINS))]
    turn = lambda i: sum(F.col(f"p_{n}") * F.get(tables[d], i) for d, n in enumerate(DOMAINS))
    start = F.lit(1.0 if max_rate is None else min(1.0, float(max_rate)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(moves) - 1)), start, lambda r, i: _clip(r - turn(i), max_rate))


def fit_rates(
    member: DataFrame, targets: dict[str, float], max_rate: float | None = None, steps: int = STEPS, tolerance: float = 1e-7
) -> Column:
    """The rate of a row as an expression of its posteriors.

    ``member`` has tokens and p_{domain}, written. ``targets`` are expected tokens. Spectral
    projected gradient: a step is as long as the last change of the rates was against the
    change of their totals, shortened while it is worse than the last ``LOOK_BACK`` points,
    never below 1 / the largest eigenvalue, with which no step is worse. The best point counts. Ends when the rates no longer move: that is
    the least-squares optimum, whether or not the targets can be met.
    """
    p = [F.col(f"p_{n}") for n in DOMAINS]
    t = F.col("tokens").cast("double")
    size = len(DOMAINS)
    first = member.agg(F.sum(t), *[F.sum(t * p[i] * p[j]) for i in range(size) for j in range(size)]).first()
    total = first[0] or 0.0
    if total == 0:
        return F.lit(1.0)
    largest = float(np.linalg.eigvalsh(np.array([v or 0.0 for v in first[1:]]).reshape(size, size)).max())
    target = np.array([targets[n] for n in DOMAINS])

    history: list[np.ndarray] = []

    def look(move: np.ndarray) -> tuple[np.ndarray, float]:
        """Residuals of the domains after ``move``, and the squared change of the rates in tokens."""
        at = member.withColumn("__from", _walk(history, max_rate))
        at = at.withColumn("__to", _clip(F.col("__from") - _dot(move), max_rate))
        turn = F.col("__to") - F.col("__from")
        got = at.agg(*[F.sum(t * q * F.col("__to")) for q in p], F.sum(t * turn * turn)).first()
        return np.array(got[:size], float) - target, float(got[size])

    off, _ = look(np.zeros(size))
    step, seen = 1 / largest, [float(off @ off)]
    for _ in range(steps):
        new, change = look(off * step)
        if new @ new > max(seen[-LOOK_BACK:]) and step > 1 / largest:
            step = max(1 / largest, step / 4)
            continue
        history.append(off * step)
        seen.append(float(new @ new))
        turn = float((new - off) @ (new - off))
        if change <= tolerance**2 * total or np.abs(new).max() <= tolerance * total:
            break
        off, step = new, max(change / turn, 1 / largest) if turn > 0 else 1 / largest
    return _walk(history[: int(np.argmin(seen))], max_rate)


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float | None], max_rate: float | None = None) -> DataFrame:
    """``docs`` with tokens, p_{domain}, rate and copies.

    ``weights`` are shares of all tokens; they need not sum to 1. None is the share that a domain has.
    Posteriors are whole GRIDths. A warning tells when the weights cannot be met; ``reached`` says by how much.
    """
    text = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    judged = posteriors(text.select("doc_id", "text"), fit_classifier(text, labels))
    whole = {n: F.round(F.col(f"p_{n}") * GRID) for n in DOMAINS[1:]}
    # Two halves may both be rounded up: the last takes what the others leave.
    whole[DOMAINS[-1]] = F.least(whole[DOMAINS[-1]], GRID - whole[DOMAINS[1]])
    rest = F.lit(float(GRID)) - sum(whole.values())
    grid = {f"p_{n}": whole.get(n, rest) / F.lit(float(GRID)) for n in DOMAINS}
    member = materialise(
        judged.select("doc_id", F.xxhash64("text").alias("text_hash"), "tokens", *[c.alias(n) for n, c in grid.items()]), "mix-members"
    )
    cells = _cells(member)
    sums = cells.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(f"p_{n}")) for n in DOMAINS]).first()
    total = sums[0] or 0
    own = dict(zip(DOMAINS, [v or 0.0 for v in sums[1:]], strict=True))
    targets = {n: own[n] if weights[n] is None else weights[n] * total for n in DOMAINS}
    rate = fit_rates(cells, targets, max_rate)
    got = cells.agg(*[F.sum(F.col("tokens") * F.col(f"p_{n}") * rate) for n in DOMAINS]).first()
    far = {n: (v or 0.0) - targets[n] for n, v in zip(DOMAINS, got, strict=True)}
    if any(abs(v) > 0.005 * total for v in far.values()):
        shown = ", ".join(f"{n} {(targets[n] + far[n]) / total:.4f} for {targets[n] / total:.4f}" for n in DOMAINS)
        warnings.warn(f"the weights cannot be met, nearest shares of all tokens: {shown}", stacklevel=2)
    uniform = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rates = member.withColumn("rate", rate)
    near = F.round("rate")
    settled = F.when(F.abs(F.col("rate") - near) < 1e-3, near).otherwise(F.floor(F.col("rate") + uniform))
    return rates.withColumn("copies", settled.cast("long"))


def reached(mixed: DataFrame) -> DataFrame:
    """(domain, had, expected, chosen): shares of all tokens before, under the rates, and after rounding to copies."""
    t, all_ = F.col("tokens"), F.sum("tokens")
    share = lambda n, times: F.sum(t * F.col(f"p_{n}") * times) / all_
    rows = [
        F.struct(
            F.lit(n).alias("domain"), share(n, F.lit(1.0)).alias("had"), share(n, F.col("rate")).alias("expected"), share(n, F.col("copies")).alias("chosen")
        )
        for n in DOMAINS
    ]
    return mixed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every document as often as its copies say; columns of ``docs``."""
    times = mixed.filter("copies != 1").select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies")
    ).distinct()
    times = materialise(times, "mix-times")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once, others = apart(docs, "doc_id", times, "__doc")
    joined = others.join(times, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    copies = F.coalesce("__copies", F.lit(1))
    chosen = joined.filter(copies > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
    return once.unionByName(chosen)
