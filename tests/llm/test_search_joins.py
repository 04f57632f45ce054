"""Ranked search and the n-gram join against brute force; hashes that clash by construction."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
import base64
import public_tokenizers
from pyspark.sql import functions as F

from orderlens.llm import bpe, linededup, nearhash, ranked, setjoin, text

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    bags = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for q, t in items:
        scored = []
        for d, bag, n in bags:
            m = 75 + (25 * n * n_docs) // total if total else 75
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 12 * m))
                for x in split(t) if bag[x]
            )
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(str(q), r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search(spark, docs, items, k):
    a = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item int, bag string").repartition(3)
    b = spark.createDataFrame([(q, t, 2) for q, t in items], "item_id long, text string, score int")
    return sorted((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranked.search(a, b, k).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401)
    draw = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    docs = [(i, draw(int(rng.integers(1, 120)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(7, draw(30)), (7, docs[9][1]), (None, draw(40)), (2000, None), (2001, ""), (2002, "?! --")]
    docs += [(3000, " ".join(["w300"] * 700)), (3001, draw(20_000)), (3002, "Ünïcode W300 w300-w5 x" + "y" * 5000)]
    items = [(i, draw(12)) for i in range(12)] + [(12, docs[5][1]), (12, "w300 W300 w300"), (13, None), (14, "?"), (None, "ünïcode Ünïcode"), (15, "nowhere")]
    return docs, items


def test_search_equals_brute_force(spark, corpus):
    docs, items = corpus
    assert search(spark, docs, items, 20) == brute_search(docs, items, 20)


def test_search_rescues_what_first_bounds_miss(spark, corpus, monkeypatch):
    """With few bounds rescored at first, tiny sketches and one item a block the result is the same."""
    docs, items = corpus
    for name, value in (("FIRST", 3), ("SECOND", 5), ("BLOCK_TERMS", 30)):
        monkeypatch.setattr(ranked, name, value)
    assert search(spark, docs, items[:4], 7) == brute_search(docs, items[:4], 7)


def test_bounds_are_bounds(corpus):
    docs, _ = corpus
    rng = np.random.default_rng(1)
    for _, t in docs[:40]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, h, tf, n = ranked.terms_of(raw, np.array([0, len(raw)]))
        for bits in (2, 6):
            at = ranked.coordinate(h, bits).astype(int)
            cells = np.zeros(1 << bits, np.int64)
            np.maximum.at(cells, at, np.minimum(tf, 255))
            raw_cells = np.array([i << 8 | int(c) for i, c in enumerate(cells) if c], np.uint32).tobytes()
            terms = np.unique(np.concatenate((h, rng.integers(1, 1 << 63, 5).astype(np.uint64))))
            items = ranked.Items(terms, (np.arange(len(terms)),), (np.ones(len(terms), np.int64),))
            w, m = np.full(len(terms), 7, np.int64), ranked.length_norm(n, 10, 100)
            exact = int((7 * ranked.impacts(tf.astype(np.int64), m[0])).sum())
            assert ranked.bounds([raw_cells], np.array([bits]), m, items, w)[0, 0] >= exact


def test_search_empty(spark):
    assert search(spark, [], [(1, "a")], 5) == [] and search(spark, [(1, "a")], [], 5) == []


def shingles(t, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) if d is not None else set() for d, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(shingles(t, k)), str(least[find(i)] if d is not None else None)) for i, (d, t) in enumerate(rows))


@pytest.fixture(scope="module")
def families():
    """Chains and stars of changed copies, strays around the threshold, copies and edge cases."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(90)]
    rows, n = [], 0
    for family in range(3):
        words = [f"{w}f{family}" for w in base]
        for _ in range(70):
            copy = list(words)
            for at in rng.choice(90, int(rng.integers(0, 5)), replace=False):
                copy[at] = f"x{rng.integers(0, 6)}"
            cut = int(rng.integers(0, 8))
            rows.append((n, " ".join(copy[: 90 - cut])))
            n += 1
    for i in range(40):
        rows.append((n, " ".join(rng.choice(base, int(rng.integers(1, 60))))))
        n += 1
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1].upper()), (n + 3, None), (n + 4, " \n"), (n + 5, "one two"), (n + 6, "ONE  two"), (None, rows[0][1])]
    return rows


def components(spark, rows, k, percent):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string").repartition(4)
    found = setjoin.jaccard_components(docs, k, percent).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


@pytest.mark.parametrize("rounds, slice_", [(4, 4096), (0, 16), (1, 4096)])
def test_join_equals_brute_force(spark, families, monkeypatch, rounds, slice_):
    """Also with no leader at all and long lists cut into slices: then every link comes from listed pairs."""
    monkeypatch.setattr(setjoin, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(setjoin, "SLICE", slice_)
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    assert components(spark, families, 4, 85) == brute_components(families, 4, 85)


def test_near_duplicates_of_changed_copies(spark, families):
    rows = [r for r in families if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = nearhash.near_duplicates(docs, k=3, percent=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_components(rows, 3, 85)


def test_join_empty(spark):
    assert components(spark, [], 4, 85) == []


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_that_clash_modulo_two_to_the_64(spark, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in nearhash.near_duplicates(docs, k=3, percent=85).collect()} == {1, 2}
    assert {r.component_id for r in setjoin.jaccard_components(docs).collect()} == {1, 2}
    assert [r.n_dropped for r in linededup.dedup_lines(docs).collect()] == [0, 0]
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: list(r.ids) for r in bpe.encode(docs, raw).collect()} == {1: own.encode_ordinary(a), 2: own.encode_ordinary(b)}
    # Words in the same order: windows of words, as the passages use them.
    x = np.array([ord(c) for c in a], np.uint64)
    y = np.array([ord(c) for c in b], np.uint64)
    assert text.window_hashes(text.mix(x), n)[0] != text.window_hashes(text.mix(y), n)[0]


def test_window_hashes_follow_the_words():
    h = text.mix(np.tile(np.arange(60, dtype=np.uint64), 3))
    found = text.window_hashes(h, 50)
    assert len(found) == 131 and found[0] == found[60] and len(np.unique(found)) == 60


def test_site_posteriors_equal_numpy(spark):
    """Planted hosts that differ: the prior's strength and what it does to a document, against NumPy."""
    from orderlens.llm import quality

    rng = np.random.default_rng(0)
    rows = [(f"h{h}", f"h{h}/p{i % 2}", float(np.clip((0.55 if h % 2 else 0.9) + rng.normal(0, 0.1), 0, 1))) for h in range(60) for i in range(12)]
    sites, rate, host_pull, path_pull = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    p = np.array([r[2] for r in rows]).reshape(60, 12)
    mean = p.mean(axis=1)
    inside = ((p - mean[:, None]) ** 2).sum() / (p.size - 60)
    between = (12 * ((mean - p.mean()) ** 2).sum() - 60 * inside) / p.size
    assert rate == pytest.approx(p.mean()) and host_pull == pytest.approx(max(inside / between, 1.0)) and host_pull < 2
    assert path_pull > 50  # the paths of a host do not differ
    low = [r for r in sites.collect() if r.host == "h1"]
    assert {r.host_n for r in low} == {12} and low[0].host_good == pytest.approx(p[1].sum())


def test_sites_change_decisions(spark):
    """A document without evidence of its own follows its site; labels and texts are the same everywhere."""
    from orderlens.llm import quality

    good = "The report was read by many people and its findings were discussed at length in town."
    bad = "$$$ CLICK CLICK CLICK $$$ 100% WIN WIN WIN $$$ ### !!!"
    rows, labels = [], []
    for i in range(400):
        site = i % 4
        text = good if site < 2 else bad
        rows.append((i, f"{text} {i}", f"s{site}", "x"))
        if i % 3 == 0:
            labels.append((i, int(site < 2), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), quality.source_path())
    for r in out.collect():
        assert (r.p_quality > r.p_document - 1e-9) if r.host in ("s0", "s1") else (r.p_quality < r.p_document + 1e-9)
        assert r.keep == (r.host in ("s0", "s1"))
