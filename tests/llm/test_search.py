"""Ranked search next to plain Python in whole numbers."""

import math
import random
import re
from collections import Counter

import naive_llm as naive
import pytest

from lexispectra.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, items, top=50):
    docs = [(i, Counter(TERM.findall((t or "").translate(naive.LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    found = {}
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(naive.LOWER)))
        scores = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: x if not x[1] else x[:2])
        if terms:
            found.setdefault(item, []).append([(k, i, -s) for k, (s, _, i) in enumerate(scores[:top], 1)])
    return found


def of(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return found


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "x1", "Été", "a", "Zug", "q%d" % rng.randrange(60), "w%d" % rng.randrange(2000)]) for _ in range(n))


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id BIGINT, text STRING, doc_id STRING")


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, items, monkeypatch, small):
    if small:  # many buckets, blocks, lots; a head of few documents
        for name, value in {"BUCKET": 8, "DOCUMENTS": 20, "ENTRIES": 300, "HEAD": 60, "LOT_TERMS": 12}.items():
            monkeypatch.setattr(search, name, value)
    rng = random.Random(8)
    texts = [None, "", " ,;", "the", "THE the", words(rng, 6000), "same text q1 w5"] + ["same text q1 w5"] * 70 + [words(rng, rng.randrange(1, 80)) for _ in range(250)]
    queries = [(1, "same text q1"), (2, words(rng, 12)), (3, words(rng, 30)), (4, None), (5, "--"), (6, "nowhere"), (7, "the"), (8, texts[100]), (9, "ÉTÉ zug")]
    found = of(search.search(docs(texts).repartition(7), items(queries)))
    expected = {k: v[0] for k, v in brute(list(enumerate(texts)), queries).items() if v[0]}
    assert found == expected
    assert len(found[1]) == 50 and [d for _, d, _ in found[1]] == list(range(6, 56))


def test_repeated_and_null_ids(docs, items):
    texts = ["red fox", "red fox", "blue fox", "red cat", None, "green"]
    given = docs(texts, [4, 4, None, 2, 2, 3])
    queries = [(1, "red fox"), (1, "red fox"), (1, "cat"), (None, "blue"), (2, None)]
    found = search.search(given, items(queries)).collect()
    assert sorted((r.rank, r.doc_id) for r in found if r.item_id == 1) == [(1, 2), (1, 4), (2, 4), (3, 2), (4, None)]
    assert [(r.rank, r.doc_id) for r in found if r.item_id is None] == [(1, None)]


def test_empty_tables(docs, items):
    assert search.search(docs([]), items([(1, "a")])).count() == 0
    found = search.search(docs(["a b"]), items([]))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs([None, ""]), items([(1, "a")])).count() == 0


def test_text_ids(spark, items):
    rows = [(i, t) for i, t in zip("dbca", ["x y", "x y", "x", "z"])]
    given = spark.createDataFrame(rows, "doc_id STRING, text STRING")
    found = search.search(given, items([(1, "x y")])).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["b", "d", "c"]


def test_impacts_of_any_size():
    import numpy as np

    n, tf = np.array([10**6, 3]), np.array([5, 1])
    documents, terms = 10**12, 10**15
    expected = [10**9 * t // (1000 * t + 20 * (50 + 50 * k * documents // terms)) for k, t in zip(n.tolist(), tf.tolist())]
    assert search.impacts(tf, n, documents, terms).tolist() == expected
