import numpy as np
import pytest

import naive
from lexispectra import RunMetrics, TrainParams, cooccurrence_files, embed, embed_files, statistics, train, train_files, vocabulary_files
from lexispectra.operators.cooccurrence import count_cooccurrence
from lexispectra.operators.pmi import pmi
from lexispectra.operators.vocabulary import build_vocab
from lexispectra.sources.cooccurrence import read_cooccurrence_bin

PARAMS = TrainParams(min_count=3, window=4, dimension=5)


def vectors(table):
    return {r["word"]: np.array(r["vector"]) for r in table.collect()}


def expected_u(texts, params):
    """Dense version of the whole pipeline."""
    ids = naive.vocabulary(texts, params.min_count)
    counts = np.zeros((len(ids), len(ids)))
    for (a, b), v in naive.cooccurrence(texts, ids, params.window, params.weighting, params.symmetric).items():
        counts[a - 1, b - 1] = v
    total = counts.sum()
    seen = counts > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log2(counts * total / np.outer(counts.sum(axis=1), counts.sum(axis=0)))
    matrix = np.where(seen & (pmi >= params.pmi_cutoff), pmi + params.pmi_shift, 0.0)
    return ids, np.linalg.svd(matrix)


@pytest.mark.parametrize("weighting,symmetric", [(1, True), (4, True), (2, False)])
def test_train_against_dense_numpy(lines, weighting, symmetric):
    params = TrainParams(min_count=3, window=4, dimension=5, weighting=weighting, symmetric=symmetric)
    texts = naive.corpus(8)
    ids, (u, s, _) = expected_u(texts, params)
    found = vectors(train(lines(texts), params))
    assert set(found) == set(ids)
    ours = np.vstack([found[w] for w in sorted(ids, key=ids.get)])
    for j in range(5):
        if min(s[j] - s[j + 1], s[j - 1] - s[j] if j else 1.0) > 0.05:
            assert abs(ours[:, j] @ u[:, j]) == pytest.approx(1.0, abs=1e-6)
    assert np.allclose(ours.T @ ours, np.eye(5), atol=1e-8)


def test_embed_from_counts_equals_train(lines):
    corpus = lines(naive.corpus(9))
    vocab = build_vocab(corpus, PARAMS.min_count)
    whole = vectors(train(corpus, PARAMS))
    saved = vectors(embed(count_cooccurrence(corpus, vocab, PARAMS.window), vocab, PARAMS))
    assert all(np.allclose(whole[w], saved[w], atol=1e-5) for w in whole)


def test_given_vocabulary_is_not_cut(lines, vocab):
    words = ["the", "w1", "w2", "w3", "w4", "w5", "w6", "unseen"]
    found = vectors(train(lines(naive.corpus(10)), TrainParams(min_count=10**6, window=4, dimension=3), vocab(words)))
    assert set(found) == set(words)
    assert not found["unseen"].any() and found["the"].any()


def test_word_without_neighbours_gets_zeros(lines):
    found = vectors(train(lines(["a b d", "c", "b d a"]), TrainParams(min_count=1, dimension=2)))
    assert list(found["c"]) == [0.0, 0.0] and found["a"].any()


def test_files(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("\n".join(naive.corpus(11)))
    first, again, third = (str(tmp_path / n) for n in ("first", "again", "third"))
    vocab, cooc = str(tmp_path / "vocab"), str(tmp_path / "cooc")
    train_files(spark, str(tmp_path / "corpus.txt"), first, PARAMS, vocab_out=vocab, cooccurrence_out=cooc)
    train_files(spark, str(tmp_path / "corpus.txt"), again, PARAMS, vocab_in=vocab)
    embed_files(spark, cooc, vocab, third, PARAMS)

    def numbers(path):
        rows = [r["value"].split(" ") for r in spark.read.text(path).collect()]
        return {r[0]: np.array(r[1:], float) for r in rows}

    one = numbers(first)
    assert len(one) > 10 and all(len(v) == 5 for v in one.values())
    for other in (numbers(again), numbers(third)):
        assert set(other) == set(one)
        assert all(np.allclose(one[w], other[w], atol=1e-5) for w in one)


@pytest.mark.parametrize("wrong", [{"window": 0}, {"dimension": 0}, {"weighting": 9}, {"min_count": -1}])
def test_parameters(wrong):
    with pytest.raises(ValueError):
        TrainParams(**wrong)


def test_outputs_are_refused_before_any_work_or_replaced(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("\n".join(naive.corpus(12)))
    corpus, out, vocab = (str(tmp_path / n) for n in ("corpus.txt", "out", "vocab"))
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError, match="out"):
        train_files(spark, corpus, out, PARAMS, vocab_out=vocab)
    assert not (tmp_path / "vocab").exists()
    train_files(spark, corpus, out, PARAMS, vocab_out=vocab, overwrite=True)
    assert spark.read.text(out).count() == spark.read.text(vocab).count() > 0


def test_stages_on_files(spark, tmp_path, lines):
    texts = naive.corpus(13)
    (tmp_path / "corpus.txt").write_text("\n".join(texts))
    corpus, vocab, cooc = (str(tmp_path / n) for n in ("corpus.txt", "vocab", "cooc"))
    vocabulary_files(spark, corpus, vocab, min_count=3)
    cooccurrence_files(spark, corpus, vocab, cooc, window=4, symmetric=False)
    words = build_vocab(lines(texts), 3)
    expected = count_cooccurrence(lines(texts), words, 4, symmetric=False)
    found = read_cooccurrence_bin(spark, cooc)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}
    sizes = {r["metric"]: r["value"] for r in statistics(lines(texts), words, pmi(expected), 0.0).collect()}
    assert sizes["tokens"] == sum(len(t.split()) for t in texts) and sizes["cells"] == expected.count() > sizes["cells_kept"]


def test_counts_beyond_the_vocabulary_are_refused(spark, vocab):
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(1, 7) for j in range(1, 7)], "row INT, col INT, val DOUBLE")
    with pytest.raises(ValueError, match="up to 6"):
        embed(cells, vocab(["a", "b"]), TrainParams(dimension=1))


def test_unique_and_symmetric_tables_need_fewer_sums(lines):
    corpus = lines(naive.corpus(9))
    words = build_vocab(corpus, PARAMS.min_count)
    cells = count_cooccurrence(corpus, words, PARAMS.window)
    plain, known = (vectors(embed(cells, words, PARAMS, **k)) for k in ({}, {"unique": True, "symmetric": True}))
    assert all(np.allclose(plain[w], known[w], atol=1e-5) for w in plain)


@pytest.mark.parametrize("given", [False, True])
def test_a_run_knows_its_sizes(lines, given):
    texts, metrics = naive.corpus(15), RunMetrics()
    corpus = lines(texts, 3)
    words = build_vocab(corpus, PARAMS.min_count)
    train(corpus, PARAMS, words if given else None, metrics)
    counts = count_cooccurrence(corpus, words, PARAMS.window)
    counted = statistics(corpus, words, pmi(counts), PARAMS.pmi_cutoff)
    expected = {r["metric"]: r["value"] for r in counted.collect() if not given or r["metric"].startswith("cells")}
    assert metrics.values() == expected and expected["cells_kept"] > 0


def test_sizes_of_an_empty_corpus(spark, lines):
    metrics = RunMetrics()
    assert build_vocab(lines([" ", ""], 1), 2, metrics=metrics).count() == 0
    sizes = {r["metric"]: r["value"] for r in metrics.table(spark).collect()}
    assert sizes == {"tokens": 0, "distinct_words": 0, "vocabulary": 0, "tokens_in_vocabulary": 0}
