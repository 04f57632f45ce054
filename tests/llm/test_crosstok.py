"""Alignment of two tokenizers against whole-text encoding by their libraries."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from orderlens.llm import crosstok

A = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
B = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def brute(rows):
    """Every document by itself, whole text at once, links by comparing all ranges."""
    tok = Tokenizer.from_str(A.decode())
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_proto=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of, n = {chr(i): i for i in shown}, 0
    for i in range(256):
        if i not in shown:
            byte_of[chr(256 + n)] = i
            n += 1
    back = {i: bytes(byte_of[c] for c in t) for t, i in json.loads(A)["model"]["vocab"].items() if all(c in byte_of for c in t)}
    found, count = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        a = b = []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            bytes_a, bytes_b = [back.get(i, b"") for i in a], [piece(i) for i in b]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a = b = []
        if a:
            end_a, end_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
            start_a, start_b = end_a - [len(x) for x in bytes_a], end_b - [len(x) for x in bytes_b]
            for j in range(len(b)):
                for i in np.flatnonzero((start_a < end_b[j]) & (end_a > start_b[j])):
                    links.append((a[i], b[j]))
            cuts = sorted(set(end_a.tolist()) & set(end_b.tolist()))
            for s, e in zip([0, *cuts[:-1]], cuts):
                groups.append(
                    ",".join(str(x) for x, y in zip(a, end_a) if s < y <= e) + "|" + ",".join(str(x) for x, y in zip(b, end_b) if s < y <= e)
                )
        count.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, groups))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (str(d), na, nb, len(g), len(l), sum(count[p] == best[p[1]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, na, nb, _, l, g in found
        ),
    )


def got(docs):
    rows = crosstok.alignment(docs, A, B).collect()
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


ODD = [
    None, "", " ", "   ", "\n", "a", " leading", "trailing  ", "two  spaces\n\n  and\tlines ", "it's we'll 'd x'S",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "▁ literal", "café   nbsp　wide   em  “quoted” — dash",
    "你好 世界 \U0001f600 \U0001f9d1‍\U0001f680 x", "zero\x00byte \x07 bell \x7f del \x85 next", "ещё раз ещё",
    "a​ b﻿ c᠎ d  e", "same words same words", "same words same words",
]


def test_odd_texts_equal_whole_text_encoding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "repeated id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pair long, block string").repartition(3)
    assert got(docs) == brute(rows)


def test_real_texts_equal_whole_text_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 1500]
    assert len(rows) > 50
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("docs", [5, 40, 65_536])
def test_planes_round_trip(docs):
    import pyarrow as pa

    rng = np.random.default_rng(docs)
    pairs, place = rng.integers(0, 30, 4000) ** 3, rng.integers(0, docs, 4000)
    distinct, planes = crosstok.planes_of(pairs, place, docs)
    row, where, times = crosstok.postings_of(pa.array(planes, pa.list_(pa.binary())), np.full(len(distinct), docs))
    back = Counter({(int(distinct[r]), int(p)): int(t) for r, p, t in zip(row, where, times)})
    assert back == Counter(zip(pairs.tolist(), place.tolist()))


def test_counts_reach_a_block_without_its_planes():
    """Counts come as a table of their own, in any order, and meet the postings by pair."""
    import pyarrow as pa

    pairs, places = np.array([7, 7, 9, 5]), np.array([0, 1, 1, 0])
    distinct, planes = crosstok.planes_of(pairs, places, 2)
    block = pa.table({"block": [3] * 3, "pair": distinct, "docs": [2] * 3, "planes": pa.array(planes, pa.list_(pa.binary()))})
    counted = pa.table({"linked": [9, 5, 7], "count": [10, 100, 1000], "best": [False, True, True]})
    scores = crosstok._scores(block, counted).to_pydict()
    assert (scores["n_best"], scores["count_sum"]) == ([2, 1], [1100, 1010])
