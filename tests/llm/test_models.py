"""Language model and toxicity: contracts next to plain Python, and quality on held-out texts."""

import math
import random
import zlib
from collections import Counter

import naive_llm as naive
import numpy as np
import pyarrow as pa
import pytest

from lexispectra.llm import lm, toxicity
from lexispectra.llm.text import blocks

random.seed(12)
FRENCH = "le la une chat chien mange dort petite maison verte rouge il elle".split()
ENGLISH = "the a cat dog eats sleeps small house green red he she it".split()


def sentence(words, n):
    return " ".join(random.choices(words, k=n))


def held(i, folds, fold):
    return zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_counts_and_base_score(docs, rows, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    texts = [None, "", "The the THE é É", sentence(FRENCH, 300), "zzz unseen-" + "x" * 5000, sentence(ENGLISH, 9000), "a b\tc\nd", "a b"]
    texts += [sentence(random.choice([FRENCH, ENGLISH]), 30) for _ in range(40)]
    ids = [None, 3, *range(10, 10 + len(texts) - 4), 7, 7]
    tokens = [[*naive.split((t or "").translate(naive.LOWER)), "\n"] for t in texts]
    count = Counter(w for i, ts in zip(ids, tokens) if not held(i, 7, 2) for w in ts)
    n, v = sum(count.values()), len(count)
    expected = sorted((i is not None, i or 0, held(i, 7, 2), len(ts), sum(w in count for w in ts), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts), 6)) for i, ts in zip(ids, tokens))
    found = lm.score(docs(texts, ids)).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in expected])
    assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)


def test_context_beats_counts_on_held_out_texts(docs):
    found = lm.score(docs([sentence(random.choice([FRENCH, ENGLISH]), 60) for _ in range(1500)])).collect()
    unseen = [r for r in found if r.held_out]
    per_token = [sum(getattr(r, k) for r in unseen) / sum(r.n_tokens for r in unseen) for k in ("base_score", "score")]
    assert per_token[1] > per_token[0] + 0.15


def test_probabilities_are_normalised():
    random_numbers = np.random.default_rng(3)
    model = lm.Model(random_numbers.normal(0, 0.5, lm.Model.start(np.ones(lm.CLASSES)).flat().size))
    before = np.tile(np.array([[5], [9]]), lm.CLASSES)
    assert np.exp(model.log_probabilities(before, np.arange(lm.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_rare_words_are_told_apart_by_their_contexts(docs):
    """Beyond the words with classes: equal words, counts and endings, but not the order they were learnt in."""
    common = [f"w{i}q" for i in range(lm.WORDS + 20)]
    left, right = ([f"{c}{i}zz" for i in range(30)] for c in "ab")
    texts = [" ".join(random.choices(common, k=1000)) for _ in range(400)] + [sentence(random.choice([left, right]), 80) for _ in range(240)]
    texts = random.sample(texts, len(texts))
    pairs = [(random.choices(left, k=10), random.choices(right, k=10)) for _ in range(60)]
    for a, b in pairs:
        texts += [" ".join(a + b), " ".join(w for pair in zip(a, b) for w in pair)]
    ids = [i for i in range(10**5) if not held(i, 7, 2)][: len(texts) - 120] + [i for i in range(10**5) if held(i, 7, 2)][:120]
    found = {r.doc_id: r for r in lm.score(docs(texts, ids)).collect()}
    learnt, mixed = ([found[i] for i in ids[-120:][k::2]] for k in (0, 1))
    assert sum(r.base_score for r in learnt) == pytest.approx(sum(r.base_score for r in mixed))
    tokens = sum(r.n_tokens for r in learnt)
    assert sum(r.score for r in learnt) / tokens > sum(r.score for r in mixed) / tokens + 0.01


def test_scores_do_not_depend_on_how_rows_are_stored(spark):
    """Several MB in partitions that adaptive execution merges; each text by its own id, one pair repeated."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, f"{i % 7}", " ".join(random.choices(words, k=random.choice([0, 5, 400, 900])))) for i in range(1500)] + [(7, "a", "twice the same row")] * 2
    given = spark.createDataFrame(rows, "doc_id BIGINT, lang STRING, text STRING")
    found = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in lm.score(x).collect()) for x in (given.repartition("lang", "doc_id"), given.orderBy("text").coalesce(2))]
    assert len(found[0]) == len(rows) and found[0] == found[1]
    count = Counter(w for i, _, t in rows if not held(i, 7, 2) for w in [*t.split(), "\n"])
    n, v = sum(count.values()), len(count)
    expected = sorted((i, len(t.split()) + 1, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*t.split(), "\n"]), 6)) for i, _, t in rows)
    assert [x[:2] for x in found[0]] == [x[:2] for x in expected]
    assert [x[3] for x in found[0]] == pytest.approx([x[2] for x in expected], abs=1e-5)


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_copies_are_averaged_by_their_weights(spark, monkeypatch, parts):
    """More copies than parts, as where Spark deals the texts to more partitions than were asked for."""
    monkeypatch.setattr(lm, "FAN_IN", 3)
    numbers = np.random.default_rng(5)
    values, weights = numbers.random((90, 4, 3)).astype(np.float32), numbers.integers(1, 50, (90, 4)).astype(np.float32)
    copies = [(k % parts, chunk, values[k].tobytes(), weights[k].tobytes()) for k in range(90) for chunk in (0, 1)]
    found = lm._averaged(spark.createDataFrame(copies, lm._COPIES).repartition(7), parts).collect()
    expected = (values * weights[:, :, None]).sum(0) / weights.sum(0)[:, None]
    assert sorted(r.chunk for r in found) == [0, 1]
    assert all(np.allclose(np.frombuffer(r.value, np.float32).reshape(4, 3), expected, atol=1e-5) for r in found)


def test_own_words_are_normalised_within_their_group():
    counts, starts = np.array([50, 20, 10, 40, 30]), np.array([0, 3, 5])
    model = lm.Model.start(np.ones(lm.CLASSES + 2), counts)
    model.parts[4][:] = np.random.default_rng(3).normal(0, 1, model.parts[4].shape)
    before = np.tile(np.array([[5], [lm.CLASSES + 4]]), 5)
    found = np.exp(model.own_log_probabilities(before, np.arange(5), starts))
    assert found[:3].sum() == pytest.approx(1, abs=1e-5) and found[3:].sum() == pytest.approx(1, abs=1e-5)


def test_scores_without_training_rows(docs):
    assert lm.score(docs([])).count() == 0
    only = next(i for i in range(100) if held(i, 7, 2))
    (row,) = lm.score(docs(["a b"], [only])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0) and math.isfinite(row.score)


CLEAN = ["".join(random.choices("abcdefghiklmnoprstuvw", k=random.randint(3, 9))) for _ in range(400)]
BAD = ["rottenbrain", "filthmonger", "scumlord", "dunceface"]


def sample(n, toxic):
    words = random.choices(CLEAN, k=n)
    for _ in range(max(1, n // 40) * toxic):
        words[random.randrange(n)] = random.choice(BAD).upper() if random.random() < 0.3 else random.choice(BAD)
    return " ".join(words)


def test_toxicity_on_held_out_texts_and_misspellings(spark, docs):
    truth = [int(i % 5 == 0) for i in range(700)]
    texts = [sample(random.choice([8, 40, 200]), t) for t in truth]
    extra = [None, "", " \n", "rottenbraim", "filthmongerr you", "Berry " * 50, sample(3000, 0), sample(3000, 0) + " scumlordd"]
    given = docs(texts + extra)
    labels = spark.createDataFrame([(i, t, "x") for i, t in enumerate(truth)] + [(5, None, "x"), (None, 1, "y"), (10**9, 1, "z")], "doc_id BIGINT, toxic INT, text STRING")
    found = {r.doc_id: r for r in toxicity.score(given, labels).collect()}
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in found.items())
    unseen = [i for i in range(700) if held(i, 3, 1)]
    right = [found[i].predicted == truth[i] for i in unseen]
    assert sum(right) / len(right) > 0.93
    assert [found[700 + k].score for k in range(3)] == [0, 0, 0]
    assert found[703].score > 0.5 and found[704].score > 0.5 and found[707].score > found[706].score
    assert found[705].predicted == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    found = toxicity.score(docs(["a b", None, "a b"], [1, 2, 1]), none).collect()
    assert len(found) == 3 and all(r.predicted == 0 for r in found)
    assert toxicity.score(docs([]), none).count() == 0


def test_subwords_are_those_of_each_word():
    (block,) = blocks(pa.array(["ab abc", None, "ab"]))
    window, doc = toxicity.windows(block)
    owner, buckets = toxicity.subwords(block, window)
    assert doc.tolist() == [0, 2] and set(buckets[owner == 1]) < set(buckets[owner == 0])
    # " ab ": 2 + 1 n-grams of 3 and 4 bytes and the word; " abc ": 3 + 2 + 1 and the word.
    assert (owner == 1).sum() == 4 and (owner == 0).sum() == 4 + 7


def test_normalisers_of_frequent_contexts_are_those_of_each_context(monkeypatch):
    """Contexts beyond the table and sums beyond 32 bits are left to the plain way; few contexts are summed one by one."""
    numbers, words = np.random.default_rng(3), 300
    model = lm.Model(numbers.normal(0, 0.5, lm.Model.start(np.ones(lm.CLASSES), np.ones(words)).flat().size), words=words).settle()
    model.parts[0][:2] *= 400
    model.settle()
    counts = numbers.integers(1, 1000, lm.CLASSES + words)
    counts[:2] = 2000
    frequent = lm.Normalisers(model, counts, 500)
    before, target = numbers.integers(0, len(counts), (2, 5000)), numbers.integers(0, lm.CLASSES, 5000)
    before[:, :4] = [[0, 1, 0, 1], [1, 0, 0, 1]]
    rows, log_sum = [], lm._log_sum
    monkeypatch.setattr(lm, "_log_sum", lambda p, s: (rows.append(len(p)), log_sum(p, s))[1])
    plain = model.log_probabilities(before, target)
    every = sum(rows)
    found = model.log_probabilities(before, target, frequent)
    assert np.allclose(found, plain, rtol=1e-5, atol=1e-4) and np.isfinite(found).all()
    held = np.isfinite(frequent.find(before))
    assert 0.2 < held.mean() < 0.7 and sum(rows) - every <= (~held).sum()
