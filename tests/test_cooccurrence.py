import math

import pytest

import naive
from lexispectra.functions.weights import exact_units, fixed_weights, weight, weighting_code
from lexispectra.operators import windows as W
from lexispectra.operators import pmi as P
from lexispectra.operators.cooccurrence import cooccurrence_units, count_cooccurrence, count_corpora, merge_cooccurrence, mirror
from lexispectra.operators.encoding import encode
from lexispectra.operators.vocabulary import build_vocab


def cells(table):
    rows = table.collect()
    found = {(r["row"], r["col"]): r["val"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_worked_example(lines, vocab):
    corpus, words = lines(["a b a", "b c"]), vocab("abc")
    symmetric = cells(count_cooccurrence(corpus, words, window=2))
    assert symmetric == {(1, 1): 1.0, (1, 2): 2.0, (2, 1): 2.0, (2, 3): 1.0, (3, 2): 1.0}
    one_sided = cells(count_cooccurrence(corpus, words, window=2, symmetric=False))
    assert one_sided == {(1, 1): 0.5, (1, 2): 1.0, (2, 1): 1.0, (2, 3): 1.0}


def test_unknown_words_close_the_window(lines, vocab):
    assert cells(count_cooccurrence(lines(["a x b"]), vocab("ab"), window=1)) == {(1, 2): 1.0, (2, 1): 1.0}


def test_lines_do_not_touch(lines, vocab):
    assert cells(count_cooccurrence(lines(["a", "b"], 1), vocab("ab"))) == {}


def test_weights():
    expected = {
        0: [1, 1, 1],
        1: [1, 1 / 2, 1 / 3],
        2: [1, 2 / 3, 1 / 2],
        3: [1, 3 / 4, 3 / 5],
        4: [1, 1 / math.sqrt(2), 1 / math.sqrt(3)],
    }
    for code, values in expected.items():
        assert [weight(code, d) for d in (1, 2, 3)] == pytest.approx(values)
        units = exact_units(code, 3)
        if code == 4:
            assert units is None
        else:
            assert [u / units.denominator for u in units.per_distance] == pytest.approx(values)
    assert weighting_code("inv_sqrt") == 4
    for wrong in (5, -1, "linear", True):
        with pytest.raises(ValueError):
            weighting_code(wrong)


# Window 25 has no small common denominator, so it takes the path of decimal weights.
@pytest.mark.parametrize("window", [1, 6, 25])
@pytest.mark.parametrize("code", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("symmetric", [True, False])
def test_against_plain_python(lines, vocab, window, code, symmetric):
    texts = naive.corpus(3, lines=15)
    ids = naive.vocabulary(texts, 5)
    found = cells(count_cooccurrence(lines(texts), vocab(sorted(ids, key=ids.get)), window, code, symmetric))
    assert found == pytest.approx(naive.cooccurrence(texts, ids, window, code, symmetric))
    if symmetric:
        assert all(found[b, a] == v for (a, b), v in found.items())


def test_steps_smaller_than_a_line(lines, vocab, monkeypatch):
    monkeypatch.setattr(W, "PAIRS_PER_STEP", 10)
    texts = naive.corpus(4, lines=5, longest=200)
    ids = naive.vocabulary(texts, 2)
    found = cells(count_cooccurrence(lines(texts), vocab(sorted(ids, key=ids.get)), 7))
    assert found == pytest.approx(naive.cooccurrence(texts, ids, 7, 1, True))


@pytest.mark.parametrize("hot_share", [3, 100_000])
def test_vocabulary_too_large_to_broadcast(lines, vocab, monkeypatch, hot_share):
    from lexispectra.operators import encoding

    monkeypatch.setattr(encoding, "_HOT_SHARE", hot_share)
    texts = naive.corpus(5)
    ids = naive.vocabulary(texts, 3)
    hot_unknown = {w: i for w, i in ids.items() if w != "w1"}
    for known in (ids, hot_unknown):
        words = vocab(sorted(known, key=known.get))
        order = {r["word"]: r["id"] for r in words.collect()}
        found = cells(count_cooccurrence(lines(texts), words, 4, broadcast_bytes=0))
        assert found == pytest.approx(naive.cooccurrence(texts, order, 4, 1, True))


def test_no_token_is_shuffled_with_a_broadcast_dictionary(lines, vocab, spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("a b\n")
    coded = encode(spark.read.text(str(tmp_path)).withColumnRenamed("value", "line"), vocab("ab"))
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_merge_of_halves_is_the_whole(lines, vocab):
    texts = naive.corpus(6)
    ids = naive.vocabulary(texts, 3)
    words = vocab(sorted(ids, key=ids.get))
    halves = [count_cooccurrence(lines(part), words, 5) for part in (texts[:20], texts[20:])]
    assert cells(merge_cooccurrence(*halves)) == pytest.approx(cells(count_cooccurrence(lines(texts), words, 5)))


@pytest.mark.parametrize("weighting", [1, 4])
def test_ids_up_to_the_largest_integer(lines, spark, weighting):
    texts = naive.corpus(12, lines=10)
    order = naive.vocabulary(texts, 2)
    ids = {w: 2**31 - 1 - i * 1_000_003 for w, i in order.items()}
    words = spark.createDataFrame([(i, w) for w, i in ids.items()], "id INT, word STRING")
    found = cells(count_cooccurrence(lines(texts), words, 5, weighting))
    assert found == pytest.approx(naive.cooccurrence(texts, ids, 5, weighting, True))


def test_corpora_are_counted_as_whole_numbers_and_mirrored_last(lines):
    first, second = lines(["a b a c", "b c"]), lines(["c a b", "a"])
    vocab = build_vocab(lines(["a b c"]), 1)
    for symmetric in (True, False):
        together = count_corpora([first, second], vocab, 3, symmetric=symmetric)
        apart = merge_cooccurrence(*[count_cooccurrence(x, vocab, 3, symmetric=symmetric) for x in (first, second)])
        found, expected = ({(r["row"], r["col"]): r["val"] for r in t.collect()} for t in (together, apart))
        assert found == pytest.approx(expected)


def test_decimal_weights_are_the_nearest():
    for code in range(5):
        for d, found in enumerate(fixed_weights(code, 40), 1):
            assert -found.as_tuple().exponent == 18 and float(found) == pytest.approx(weight(code, d), rel=1e-15)


@pytest.mark.parametrize("weighting,window", [(4, 5), (1, 30), (3, 30)])
@pytest.mark.parametrize("symmetric", [True, False])
def test_sums_have_equal_digits_in_any_order(lines, vocab, monkeypatch, weighting, window, symmetric):
    texts = naive.corpus(13, lines=25)
    ids = naive.vocabulary(texts, 2)
    words = vocab(sorted(ids, key=ids.get))
    worth = fixed_weights(weighting, window)
    expected = {}
    for text in texts:
        known = [ids[w] for w in text.split() if w in ids]
        for right, b in enumerate(known):
            for d in range(1, min(window, right) + 1):
                a = known[right - d]
                for cell in [(a, b), (b, a)][: 2 if symmetric else 1]:
                    expected[cell] = expected.get(cell, 0) + worth[d - 1]
    sums = {}
    for (a, _), v in expected.items():
        sums[a] = sums.get(a, 0) + v
    for partitions, step, order in [(1, 4_000_000, texts), (3, 40, texts[::-1]), (7, 9, texts[::2] + texts[1::2])]:
        monkeypatch.setattr(W, "PAIRS_PER_STEP", step)
        found, denominator = cooccurrence_units(lines(order, partitions), words, window, weighting, symmetric)
        assert denominator == 1 and cells(found) == expected
        assert {r["row"]: r["row_total"] for r in P.row_marginal(found).collect()} == sums
        assert P.cooc_total(found.repartition(partitions)).first()["total"] == sum(sums.values())


def test_decimal_cells_merge_and_mirror_without_loss(lines, vocab):
    texts = naive.corpus(14)
    ids = naive.vocabulary(texts, 3)
    words = vocab(sorted(ids, key=ids.get))
    halves = [cooccurrence_units(lines(part), words, 6, 4, True, mirrored=False)[0] for part in (texts[:20], texts[20:])]
    whole = cooccurrence_units(lines(texts), words, 6, 4, True)[0]
    together = mirror(merge_cooccurrence(*halves))
    assert cells(together) == cells(whole) and together.schema["val"].dataType == whole.schema["val"].dataType
