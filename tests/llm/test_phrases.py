"""Collocations next to plain Python."""

import random
import re
from collections import Counter

import naive_llm as naive
import pytest

from lexispectra.llm import phrases


def brute(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(naive.LOWER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            total[lang] += len(words)
            for k in range(1, 6):
                count.update((lang, w) for w in naive.windows(words, k))
    held = {x: f for x, f in count.items() if f >= least}
    covered = set()
    for (lang, g), f in held.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if held[lang, g[i : i + k]] <= f:
                    covered.add((lang, g[i : i + k]))
    found = {}
    for (lang, g), a in held.items():
        if len(g) > 1 and (lang, g) not in covered:
            n = total[lang]
            cuts = [(1000 * a * n // (held[lang, g[:k]] * held[lang, g[k:]]), k, held[lang, g[:k]], held[lang, g[k:]]) for k in range(1, len(g))]
            score, _, l, r = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r, n))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, own in found.items() for i, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1))


def corpus(rng):
    vocabulary = ["The", "of", "été", "new", "york", "city", "x\x01", "z\u0085z", " ", "a", "b"]
    rows = [(None, None), ("en", ""), ("en", " \t.\n"), ("de", "one two"), ("fr", "z " * 3000), ("x", "spam ham " * 40 + ". spam ham eggs")]
    for _ in range(260):
        own = []
        for _ in range(rng.randrange(1, 25)):
            own += rng.choice([["New", "York", "city"], ["state", "of", "the", "art", "now"], ["a", "b"], [rng.choice(vocabulary)], ["q%d" % rng.randrange(30)]])
        rows.append((rng.choice(["en", "en", "fr", "", None]), rng.choice([" ", "\t ", "  "]).join(w + rng.choice(["", "", "", ",", ".", "\n", "\r"]) for w in own)))
    return rows


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, lang, t, 1, "w") for i, (lang, t) in enumerate(rows)], "id BIGINT, lang STRING, text STRING, n INT, words STRING")


@pytest.mark.parametrize("numbered, batch, top", [(4_000_000, 10_000, 2000), (4_000_000, 7, 9), (0, 50, 2000)])
def test_against_brute_force(spark, table, monkeypatch, numbered, batch, top):
    monkeypatch.setattr(phrases, "NUMBERED", numbered)
    monkeypatch.setattr(phrases, "TASK_WINDOWS", 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = corpus(random.Random(9))
        found = phrases.collocations(table(rows).repartition(3), least=12, top=top)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute(rows, 12, top)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables_and_nothing_frequent(table):
    assert phrases.collocations(table([])).count() == 0
    assert phrases.collocations(table([("en", "a b c"), (None, None)])).count() == 0


def test_a_step_is_bounded_by_bytes_whatever_the_rows_of_a_batch(spark, table, monkeypatch):
    monkeypatch.setattr(phrases, "STEP_BYTES", 300)
    seen = spark.sparkContext.accumulator(0)
    real = phrases._pieces

    def pieces(batch):
        sizes = [len((t or "").encode()) for t in batch.column("text").to_pylist()]
        assert len(sizes) == 1 or sum(sizes) <= 300
        seen.add(len(sizes))
        return real(batch)

    monkeypatch.setattr(phrases, "_pieces", pieces)
    rows = corpus(random.Random(9))
    assert sorted(map(tuple, phrases.collocations(table(rows).repartition(2), least=12).collect())) == brute(rows, 12, 2000)
    assert seen.value >= 2 * len(rows)


def test_repeated_rows_count_again(table):
    (row,) = phrases.collocations(table([("en", "big bang")] * 100)).collect()
    assert tuple(row) == ("en", 1, "big bang", 100, 100, 100, 200, 2000)


def test_scores_beyond_64_bits(spark):
    columns = "words ARRAY<BIGINT>, f BIGINT, n BIGINT, l1 BIGINT, l2 BIGINT, l3 BIGINT, l4 BIGINT, r1 BIGINT, r2 BIGINT, r3 BIGINT, r4 BIGINT"
    a, n, l, r = 10**12, 10**15, 10**12 + 7, 10**12 + 3
    row = spark.createDataFrame([([1, 2], a, n, l, None, None, None, r, None, None, None)], columns).select(phrases._least_cut().alias("best")).first()["best"]
    assert (row["score"], row["cut"], row["l"], row["r"]) == (1000 * a * n // (l * r), 1, l, r)


@pytest.mark.parametrize("largest", [1, 100, 70_000, 1 << 21, 1 << 31, None])
def test_packing_round_trip(largest):
    import numpy as np

    packing = phrases.Packing(largest)
    words = np.random.default_rng(1).integers(0, (largest or (1 << 62)) + 1, (50, phrases.LONGEST)).astype(np.uint64)
    columns = packing.pack(words)
    assert (packing.unpack(columns).astype(np.uint64) == words).all()
    if largest:
        order = np.lexsort(columns[::-1])
        assert words[order].tolist() == sorted(words.tolist())
