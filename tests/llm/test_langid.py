"""Language ID against Kneser-Ney by definition, and the calibration of its rejection."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import langid

SF = "/root/testdata/sf0.01"


def characters(text):
    """(context of three, character) of each judged position."""
    u = "   " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    return [(u[p - 3 : p], u[p]) for p in range(3, len(u)) if not (u[p] == u[p - 1] == " ")]


class ByDefinition:
    """Dictionaries in place of arrays: counts for four characters, numbers of left neighbours below."""

    def __init__(self, texts, alphabet):
        self.alphabet, self.n = alphabet, {}
        self.n[4] = Counter(c + x for t in texts for c, x in characters(t))
        for k in (3, 2, 1):
            left = defaultdict(set)
            for g in self.n[k + 1]:
                left[g[1:]].add(g[0])
            self.n[k] = {g: len(s) for g, s in left.items()}
        self.total, self.kinds, self.discount = {}, {}, {}
        for k, n in self.n.items():
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, c in n.items():
                self.total[k][g[:-1]] += c
                self.kinds[k][g[:-1]] += 1
            one, two = (sum(c == m for c in n.values()) for m in (1, 2))
            self.discount[k] = one / (one + 2 * two) if one and two else 0.5

    def p(self, context, x, k=4):
        if k == 0:
            return 1 / self.alphabet
        context = context[len(context) - (k - 1) :]
        lower = self.p(context[1:], x, k - 1)
        if context not in self.total[k]:
            return lower
        d, total = self.discount[k], self.total[k][context]
        return max(self.n[k].get(context + x, 0) - d, 0) / total + d * self.kinds[k][context] / total * lower

    def entropy(self, text):
        steps = characters(text)
        return -sum(math.log2(self.p(c, x)) for c, x in steps) / len(steps)


def test_cross_entropy_equals_definition(spark):
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 8)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    learn = [(text("abcdeÄß", 40), "aa") for _ in range(8)] + [(text("cdefg", 60) + ", 12  " + text("Ωж中", 5), "bb") for _ in range(5)]
    learn += [("x", "cc"), ("", "cc"), ("aab aab", "aa")]
    models = langid.fit(langid.count_grams(spark.createDataFrame(learn, "text string, lang string").repartition(3)))
    by = defaultdict(list)
    for t, lang in learn:
        by[lang].append(t)
    alphabet = len({x for t, _ in learn for _, x in characters(t)}) + 1
    plain = {lang: ByDefinition(ts, alphabet) for lang, ts in by.items()}
    asked = [t for t, _ in learn if t] + [text("abcdefgxyzß中", 30) for _ in range(20)] + ["q", "  A-b  c\n", "жжж 中", "x x x"]
    langs, scores, bits = langid.judge(models, asked)
    for t, lang, score, b in zip(asked, langs, scores, bits, strict=True):
        entropy = {name: m.entropy(t) for name, m in plain.items()}
        least = min(entropy.values())
        assert b == pytest.approx(least, abs=1e-4) and entropy[lang] == pytest.approx(least, abs=1e-4)
        assert score == pytest.approx(1 / sum(2 ** (8 * (least - e)) for e in entropy.values()), abs=1e-3)
    for m in plain.values():  # what is compared with is a distribution over the alphabet
        seen = sum(m.p("ab ", x) for x in m.n[1])
        assert seen + (alphabet - len(m.n[1])) * m.p("ab ", "?") == pytest.approx(1)


def test_limits_of_rejection(spark):
    """Quantile of distinct texts of the right language; languages with few texts take the pooled quotient."""
    rows = [("aa", "aa", 1 + i / 1000, i) for i in range(1000)] + [("aa", "aa", 9.0, 5000)] * 400
    rows += [("bb", "bb", 2.0, 7000 + i) for i in range(10)] + [("bb", "aa", 50.0, 8000), ("cc", "und", None, 8001)]
    said = spark.createDataFrame(rows, "lang string, lang_pred string, cross_entropy double, text_hash long")
    most = {r.lang_pred: r.most for r in langid.limits(said).collect()}
    own = sorted({b for lang, pred, b, _ in rows if lang == pred == "aa"})
    assert most["aa"] == own[math.ceil(0.99 * len(own)) - 1]
    ratios = sorted([b / np.mean(own) for b in own] + [1.0] * 10)
    factor = ratios[math.ceil(0.99 * len(ratios)) - 1]
    assert most["bb"] == pytest.approx(2 * factor) and set(most) == {"aa", "bb", None}
    assert langid.limits(said.limit(0)).count() == 0


def test_rejection_of_a_language_left_out(spark):
    """Fresh texts of learnt languages are rejected about as rarely as asked for, a language not learnt mostly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    fresh = docs.withColumn("held_out", langid.held_out(F.col("doc_id"))).filter("held_out").select("doc_id", F.col("lang").alias("truth"))
    strange = docs.groupBy("lang").count().orderBy("count", "lang").first().lang
    rows = langid.identify(docs.withColumn("lang", F.when(F.col("lang") != strange, F.col("lang")))).join(fresh, "doc_id").collect()
    learnt = [r for r in rows if r.truth != strange]
    other = [r for r in rows if r.truth == strange]
    assert np.mean([r.lang_pred == r.truth for r in learnt]) > 0.98
    assert np.mean([r.rejected for r in learnt]) < 0.05
    assert len(other) > 5 and np.mean([r.rejected for r in other]) > 0.9
