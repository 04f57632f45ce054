"""Edge cases and brute-force comparisons of the text operators, on small tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orderlens.llm import bpe, chaining, graph_ann, imatch, langid, linededup, mixing, nearhash, quality, warc

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int"


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = sentence(1, 300).split()
    near = base.copy()
    near[150] = "changed"
    rows = [
        (0, " ".join(base), "en", "a"),
        (1, " ".join(near), "en", "a"),
        (2, " ".join(base), "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, "  \n \n", "de", None),
        (6, "one two", "de", "c"),
        (7, "ONE two", None, "c"),
        (8, "same shared line\n" + sentence(2, 60), "en", "c"),
        (9, "first\n  SAME shared line \nlast", "fr", "c"),
        (10, "same shared line", "fr", "c"),
        (11, sentence(3, 40_000), "en", "c"),
        (12, "x" * 50_000, "en", "c"),
        (13, sentence(4, 80) + " " + " ".join(base[50:150]), "en", "c"),
        (13, sentence(5, 20), "en", "c"),
        (14, "12 34 !?", "en", "c"),
        (None, "same shared line", "en", "c"),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), True, 1) for i, t, l, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (1, 1, 0), (2, 1, None), (6, 0, 0), (8, 1, 1), (12, 0, None), (None, 1, 0), (9, None, None), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(docs):
    got = {r.doc_id: r for r in nearhash.near_duplicates(docs, 3, 85).collect() if r.doc_id is not None and r.doc_id != 13}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 13}
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    part = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    assert {i: r.component_id for i, r in got.items()} == part
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert nearhash.near_duplicates(docs.limit(0)).count() == 0


def test_lines_and_reversal(docs):
    rows = linededup.lines(docs)
    state = linededup.add(linededup.empty_state(rows), rows)
    out = {r.doc_id: r for r in linededup.clean(state, docs, rows).collect() if r.doc_id not in (None, 13)}
    assert out[9].kept_text == "first\nlast" and (out[9].n_lines, out[9].n_dropped) == (3, 1)
    assert out[10].kept_text == "" and out[8].n_dropped == 0 and out[2].kept_text == ""
    assert (out[3].n_lines, out[3].kept_text) == (1, "")
    # Without document 8 the line belongs to document 9.
    left = linededup.remove(state, docs.filter("doc_id = 8").select("doc_id"))
    again = {r.doc_id: r for r in linededup.clean(left, docs.filter("doc_id != 8"), rows.filter("doc_id != 8")).collect()}
    assert again[9].n_dropped == 0 and again[10].n_dropped == 1
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 62), 1 << 62, 20_000)
    cuckoo = linededup.Cuckoo.sized(len(keys))
    assert len(cuckoo.insert(keys)) == 0 and cuckoo.has(keys).all()
    assert cuckoo.has(rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.001
    assert len(cuckoo.delete(keys[:10_000])) == 0
    assert cuckoo.has(keys[10_000:]).all() and cuckoo.has(keys[:10_000]).mean() < 0.001


def test_cuckoo_layers_forget_only_what_is_deleted():
    """Prints that are alike only in the small layer: the keys left are found after any order of deletions."""
    rng = np.random.default_rng(5)
    keys = rng.choice(1 << 60, 130_000, replace=False)
    change = lambda part: pd.DataFrame({"h1": part})
    filters = pd.DataFrame(columns=["kind", "shard", "layer", "buckets", "used", "slots"])
    early, late = keys[:10_000], keys[10_000:]
    for part in (early, late[:20_000], late[20_000:]):
        filters = linededup._update(("held", 0), filters, change(part), True)
    assert len(filters) == 3
    for gone, left in ((late[:100_000], np.concatenate((early, late[100_000:]))), (early[:5_000], np.concatenate((early[5_000:], late[100_000:])))):
        filters = linededup._update(("held", 0), filters, change(gone), False)
        layers = linededup._layers(filters)
        assert np.logical_or.reduce([x.has(left) for x in layers]).all()
    assert filters["used"].sum() == len(left)


def test_lines_added_and_removed_in_turns(docs):
    """Documents that come and go again and again leave the state of those that stayed."""
    rows = linededup.lines(docs)
    some = lambda *ids: rows.filter(F.col("doc_id").isin(*ids))
    state = linededup.add(linededup.empty_state(rows), some(0, 8, 11))
    state = linededup.add(state, some(1, 9, 10, 13))
    state = linededup.remove(state, docs.filter("doc_id in (8, 1)").select("doc_id"))
    state = linededup.add(state, some(8, 2))
    state = linededup.remove(state, docs.filter("doc_id in (8, 11)").select("doc_id"))
    stay = (0, 2, 9, 10, 13)
    kept = docs.filter(F.col("doc_id").isin(*stay))
    shown = lambda df: sorted((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect())
    assert shown(linededup.clean(state, kept, some(*stay))) == shown(linededup.dedup_lines(kept))
    assert {(r.h1, r.h2, r.doc_id) for r in state.refs.collect()} == {(r.h1, r.h2, r.doc_id) for r in some(*stay).collect()}


def test_bpe_equals_public_library(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(t,) for t in ["it's we'll 'x", "a  b\n\n c \t", "é中🎉 ½", "<|endoftext|>", "'s's 's", "", None]], "text string")
    for df in (docs.select("text"), more):
        rows = bpe.decode(bpe.encode(df.withColumn("own", F.col("text")), RANKS), RANKS).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert r.ids == public.encode_ordinary(r.own or "") and bytes(r.decoded).decode() == (r.own or "")
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "http://b\r\n", ""), (4, "u", "é"), (9, "u", "é"), (9, "u", "é"), (None, "u", "é")]
    pages = warc.records_of(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    for name, least, revisits in (("all", 0, {3: 2, 9: 4}), ("large", 2, {9: 4}), ("none", 3, {})):
        warc.write_archives(warc.mark_revisits(pages, least), str(tmp_path / name))
        got = warc.resolve(warc.read_archives(spark, str(tmp_path / name))).collect()
        assert len(got) == len(rows)
        assert {r.record_id: r.refers_to for r in got if r.record_type == "revisit"} == revisits
        for r in got:
            html = next(h for i, _, h in rows if i == r.record_id) or ""
            assert bytes(r.payload) == html.encode() and r.payload_bytes == len(html.encode())
            assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_imatch(docs):
    rows = imatch.fingerprints(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 13)}
    assert by[0].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for a, b in ((12, 11), (1, 0), (0, 14)):
        m = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - m] + texts[b][:m]
        assert by[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_imatch_whole_lexicon(spark):
    """Every term of the band counts, in the plan or joined: 30,000 of them, each in two of 150 documents."""
    rows = [(d, " ".join(f"t{i}" for h in (d // 2, 75 + (d + 1) // 2 % 75) for i in range(h * 200, h * 200 + 200))) for d in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {w for _, t in rows for w in t.split()}
    assert len(terms) == 30_000 and imatch.band(table).count() == 30_000
    every = table.withColumn("__every", imatch.term_hashes(F.col("text")))
    kept = imatch.lexicon(table)(every).select(F.size("__banded").alias("n"), F.size("__every").alias("m")).collect()
    assert all(r.n == r.m == 400 for r in kept)
    made = {r.doc_id: r for r in imatch.fingerprints(table).collect()}
    assert made == {r.doc_id: r for r in imatch.fingerprints(table, in_plan=0).collect()}
    # One term less changes the fingerprint, whichever term it is.
    less = [(d, t.rsplit(" ", 1)[0]) for d, t in rows]
    banded = imatch.lexicon(table)
    show = lambda df: {r.doc_id: r.fingerprint for r in imatch.with_fingerprint(df, "text", banded).collect()}
    whole, cut = show(table), show(spark.createDataFrame(less, "doc_id long, text string"))
    assert all(whole[d] != cut[d] for d in whole)


def test_language(docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_pred == by[4].lang_pred == by[14].lang_pred == "und" and by[0].lang_pred == "en"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_with_little_text(spark):
    """A rare language is learnt whole beside more than 2^20 grams of another."""
    letter = lambda bits, n: F.shiftleft(F.lit(0x4E00) + F.shiftright("id", bits) % n, 48 - (bits // 5) * 16)
    gram = letter(0, 32) + letter(5, 32) + letter(10, 32) + letter(15, 64)
    common = spark.range((1 << 20) + 1000).select(F.lit("aa").alias("lang"), gram.alias("gram"), F.lit(2).cast("long").alias("n"))
    text = sentence(7, 40)
    rare = langid.count_grams(spark.createDataFrame([(text, "zz")], "text string, lang string"))
    models = langid.fit(common.unionByName(rare))
    assert models.langs == ["aa", "zz"]
    assert langid.judge(models, [text])[0] == ["zz"]
    # Alone or beside the other language the same grams are known.
    alone = langid.fit(rare)
    assert len(models.grams[4][0]) == (1 << 20) + 1000 + len(alone.grams[4][0])


def test_quality(docs, labels):
    rows = quality.judge(docs, labels, F.col("source"), quality.source_path()).collect()
    assert len(rows) == docs.count() and all(0 <= r.p_quality <= 1 for r in rows)
    none = quality.judge(docs, labels.limit(0), F.col("source"), quality.source_path()).collect()
    assert len(none) == docs.count() and all(r.keep and r.p_quality is None for r in none)
    assert quality.keep_good(docs.limit(0), labels, F.col("source"), quality.source_path()).count() == 0


def test_mixing(docs, labels):
    out = mixing.mix_documents(docs, labels, {"good": 0.7, "toxic": 0.2, "poor": 0.1}).collect()
    assert len(out) == docs.count() and all(r.rate >= 0 for r in out)
    member = docs.sparkSession.createDataFrame(
        [(10, 0.8, 0.1, 0.1), (20, 0.1, 0.8, 0.1), (30, 0.2, 0.2, 0.6), (5, 0.4, 0.3, 0.3)],
        "tokens long, p_good double, p_toxic double, p_poor double",
    )
    target = {"good": 20.0, "toxic": 15.0, "poor": 25.0}
    rate = mixing.fit_rates(member, target)
    got = member.select(*[F.sum(F.col("tokens") * rate * F.col(f"p_{n}")) for n in mixing.DOMAINS]).first()
    assert np.allclose(list(got), list(target.values()), atol=1e-6)
    assert mixing.mix_documents(docs.limit(0), labels, target).count() == 0
    assert mixing.apply_mix(docs, mixing.mix_documents(docs, labels.limit(0), {n: 1 / 3 for n in mixing.DOMAINS})).columns == docs.columns


@pytest.mark.parametrize(
    "target, most", [((0.9, 0.02, 0.05), None), ((0.9, 0.02, 0.05), 1.0), ((1.05, 0.02, 0.01), 1.0), ((0.0, 0.0, 0.0), None)]
)
def test_rates_equal_a_slow_solver(spark, target, most):
    """Also where bounds hold and the targets cannot be met."""
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet([4, 0.4, 0.4], 400), rng.integers(0, 500, 400).astype(float)
    wanted = np.array(target) * t.sum()
    r = np.full(400, 1.0)
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    for _ in range(50_000):
        r = np.clip(r - step * (p @ ((p * (t * r)[:, None]).sum(axis=0) - wanted)), 0, most)
    slow = np.sqrt((((p * (t * r)[:, None]).sum(axis=0) - wanted) ** 2).sum())
    member = spark.createDataFrame([(int(n), *map(float, row)) for n, row in zip(t, p)], "tokens long, p_good double, p_toxic double, p_poor double")
    rate = mixing.fit_rates(member, dict(zip(mixing.DOMAINS, wanted)), most)
    got = np.array([x[0] for x in member.select(rate).collect()])
    assert (got >= 0).all() and (most is None or (got <= most).all())
    fast = np.sqrt((((p * (t * got)[:, None]).sum(axis=0) - wanted) ** 2).sum())
    assert fast <= slow + 1e-3 * t.sum()


def test_reached_shares(spark, docs, labels):
    with pytest.warns(UserWarning, match="cannot be met"):
        mixed = mixing.mix_documents(docs, labels, {"good": 5.0, "toxic": 0.0, "poor": 0.0}, max_rate=1.0)
    by = {r.domain: r for r in mixing.reached(mixed).collect()}
    assert by["good"].expected <= by["good"].had + 1e-9 and abs(sum(r.had for r in by.values()) - 1) < 1e-9
    kept = mixing.mix_documents(docs, labels, {n: None for n in mixing.DOMAINS}, max_rate=1.0)
    assert kept.filter("copies != 1").count() == 0


def test_passages(docs):
    rows = chaining.repeated_passages(docs).collect()
    pairs = {(r.doc_a, r.doc_b): r for r in rows}
    assert {(0, 1), (0, 2), (0, 13)} <= set(pairs)
    assert pairs[(0, 2)].equal_words == 300 and (pairs[(0, 1)].start_a, pairs[(0, 1)].end_a, pairs[(0, 1)].equal_words) == (0, 300, 299)
    assert (pairs[(0, 13)].start_a, pairs[(0, 13)].end_a) == (50, 150)
    assert not {11, 12} & {i for p in pairs for i in p}
    assert chaining.repeated_passages(docs.limit(0)).count() == 0


def test_passages_behind_pieces(spark):
    """Every shared run of 50 words is linked, though smaller documents hold pieces of it."""
    rng = np.random.default_rng(8)
    texts = {}
    for case in range(12):
        whole = sentence(100 + case, 60 + int(rng.integers(0, 60))).split()
        n, doc = len(whole), case * 100
        for i in range(4):  # pieces of under 50 words, which together hold every seed
            at = int(rng.integers(0, n - 45)) if i > 1 else (0 if i == 0 else n - 45)
            texts[doc + i] = [*sentence(1000 + doc + i, 30).split(), *whole[at : at + 45], *sentence(2000 + doc + i, 9).split()]
        texts[doc + 10] = [*sentence(3000 + doc, 12).split(), *whole]
        texts[doc + 20] = [*whole, *sentence(4000 + doc, 12).split()]
        texts[doc + 30] = whole[:52]
    texts[5000], texts[5001] = ["x"] * 300, ["y", *["x"] * 120, "z", *["x"] * 60]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(3)
    rows = chaining.repeated_passages(table).collect()
    runs = {}
    for d, words in texts.items():
        for i in range(len(words) - 49):
            runs.setdefault(tuple(words[i : i + 50]), []).append((d, i))
    shared = [h for h in runs.values() if len({d for d, _ in h}) > 1]
    assert shared
    for holders in shared:
        first = min(d for d, _ in holders)
        for d, i in holders:
            assert d == first or any(r.doc_a == first and r.doc_b == d and r.start_b <= i and i + 50 <= r.end_b for r in rows), (first, d, i)
    assert all(r.equal_words >= 0.8 * max(r.end_a - r.start_a, r.end_b - r.start_b) for r in rows)


def test_changed_passages_behind_pieces(spark):
    """A changed passage whose seeds all lead to smaller documents, few or many, that hold a piece of it."""
    texts = {}
    for case in range(6):
        whole, doc = sentence(7000 + case, 70).split(), case * 100
        for i, at in enumerate(range(0, 40, 6)):
            texts[doc + i] = [*sentence(7100 + doc + i, 30).split(), *whole[at : at + 40], *sentence(7900 + doc + i, 9).split()]
        for i, changed in ((10, 20), (20, 48)):
            copy = list(whole)
            copy[changed] = f"changed{i}"
            texts[doc + i] = [*sentence(8000 + doc + i, 12).split(), *copy, *sentence(8700 + doc + i, 12).split()]
    line = sentence(9000, 24).split()  # of every document from 10,000 on; only three share more
    around, other = sentence(9001, 23).split(), sentence(9002, 23).split()
    for i in range(80):
        texts[10_000 + i] = [*sentence(9100 + i, 60).split(), *line, *sentence(9200 + i, 60).split()]
    for i, every in ((10_100, 0), (10_101, 6), (10_102, 7)):  # no seed outside of the line
        before, after = list(around), list(other)
        for words in (before, after):
            for at in range(every - 2, len(words), every) if every else ():
                words[at] = f"changed{i}-{at}"
        texts[i] = [*sentence(9300 + i, 40).split(), *before, *line, *after, *sentence(9400 + i, 40).split()]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(3)
    pairs = {(r.doc_a, r.doc_b): r for r in chaining.repeated_passages(table).collect()}
    for case in range(6):
        r = pairs[(case * 100 + 10, case * 100 + 20)]
        assert (r.start_a, r.end_a, r.start_b, r.end_b, r.equal_words) == (12, 82, 12, 82, 68)
    assert {b for a, b in pairs if a == 10_100} == {10_101, 10_102}
    assert all(a >= 10_100 for a, b in pairs if b >= 10_000) and not any(b in range(10_000, 10_100) for _, b in pairs)


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(600, None, 1), (650, [], 1), (700, [0.0] * 16, 1), (750, [float("nan")] * 16, 1), (800, [None] * 16, 1), (850, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, node int")
    got: dict[int, list] = {}
    for r in sorted(graph_ann.nearest(df).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 60
    assert graph_ann.nearest(df.limit(0)).count() == 0
    assert [r.vec_id for r in sorted(graph_ann.nearest(df.filter("vec_id < 3")).collect())] != []


def test_payload_is_hashed_once(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    shown = warc.records_of(pages, "page_id", "url", "html")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1


def test_passage_query_names_documents_by_doc_id(spark):
    from orderlens.llm.queries import op4_passages

    found = op4_passages(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes)["doc_id"] == dict(found.dtypes)["other_doc_id"] == "bigint"
    rows = chaining.repeated_passages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted((r.doc_b, r.start_b, r.end_b, r.doc_a, r.start_a, r.end_a, r.equal_words, r.identity) for r in rows) == sorted(map(tuple, found.collect()))
    assert all(r.doc_id > r.other_doc_id for r in found.collect())
