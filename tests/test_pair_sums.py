import numpy as np
import pytest

import naive
from lexispectra.operators import pair_sums as P
from lexispectra.operators.cooccurrence import count_cooccurrence, count_corpora, merge_cooccurrence
from lexispectra.operators.svd import sparse_rows
from lexispectra.plans.params import TrainParams
from lexispectra.plans.pipeline import staged_counts


@pytest.mark.parametrize("bands", [1, 3, 300])
@pytest.mark.parametrize("held", [4, 8_000_000])
def test_packed_blocks_give_back_their_sums(monkeypatch, bands, held):
    monkeypatch.setattr(P, "HELD", held)
    rng, largest = np.random.default_rng(5), 2**31 - 1
    worth = np.array([[0, 2520, 1260], [0, 10**9 - 1, 7]])
    expected, steps = {}, []
    for _ in range(6):
        ids = rng.choice([1, 2, 3, 70_000, largest - 1, largest], (40, 2))
        row, col = ids[np.lexsort((ids[:, 1], ids[:, 0]))].T.astype(np.int64)
        distance, n = rng.integers(1, 3, 40), rng.integers(1, 1000, 40)
        steps.append((row, col, distance, n))
        for a, b, d, m in zip(row.tolist(), col.tolist(), distance, n):
            expected[a, b] = expected.get((a, b), 0) + worth[:, d] * m
    found = {}
    for batch in P._collected(iter(steps), worth, bands):
        for r in batch.to_pylist():
            at = np.cumsum(P._numbers(r["cells"], r["n"]))
            sums = np.stack([P._numbers(s, r["n"]) for s in r["sums"]], 1)
            for k, s in zip(at.tolist(), sums):
                cell = k // r["width"] * bands + r["p"] + 1, k % r["width"] * bands + r["q"] + 1
                found[cell] = found.get(cell, 0) + s
    assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in expected.items()}


def test_a_block_of_many_cells_is_not_merged_for_every_row(monkeypatch):
    monkeypatch.setattr(P, "HELD", 100)
    held, merges, merge = P._Sums(), [], P._Sums.merge
    monkeypatch.setattr(P._Sums, "merge", lambda self: (merges.append(self.size), merge(self)))
    for k in range(400):
        held.add(np.arange(5) * 400 + k, np.full((1, 5), k + 1))
    cells, sums = held.take()
    assert cells.tolist() == list(range(2000)) and sums.tolist() == [[k % 400 + 1 for k in range(2000)]]
    assert len(merges) < 25


def test_no_pair_is_a_row_of_the_shuffle(lines, vocab, capsys):
    texts = naive.corpus(3, lines=15)
    ids = naive.vocabulary(texts, 5)
    count_cooccurrence(lines(texts), vocab(sorted(ids, key=ids.get)), 4).explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan.split("FlatMapGroupsInArrow")[1] and plan.count("hashpartitioning(p#") == 1


def test_corpora_counted_together_have_the_digits_of_their_tables_merged(lines, vocab):
    texts = naive.corpus(8, lines=60)
    ids = naive.vocabulary(texts, 2)
    words, parts = vocab(sorted(ids, key=ids.get)), [lines(texts[:25]), lines(texts[25:])]
    together = count_corpora(parts, words, 10)
    apart = merge_cooccurrence(*[count_cooccurrence(x, words, 10) for x in parts])
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def test_a_symmetric_table_is_stored_once(lines, vocab):
    texts = naive.corpus(3, lines=15)
    ids = naive.vocabulary(texts, 5)
    cells, _ = staged_counts(lines(texts), vocab(sorted(ids, key=ids.get)), TrainParams(window=4, dimension=2))
    stored = cells.sparkSession.read.parquet(cells.inputFiles()[0].rsplit("/", 1)[0])
    assert stored.where("row > col").isEmpty() and cells.count() == 2 * stored.count() - stored.where("row = col").count()


def test_sparse_rows_are_sorted_not_collected(spark, capsys):
    entries = [(r, c, r * 100 + c) for r in (1, 2, 9) for c in (1, 70_000, 5, 65_536, 65_537)]
    found = sparse_rows(spark.createDataFrame(entries, "row INT, col INT, val BIGINT"), "val")
    assert {(r["row"], r["piece"]): (r["cols"], r["vals"]) for r in found.collect()} == {
        (r, p): (cols, [r * 100 + c for c in cols]) for r in (1, 2, 9) for p, cols in ((0, [1, 5, 65_536]), (1, [65_537, 70_000]))
    }
    found.explain()
    assert "ObjectHashAggregate" not in capsys.readouterr().out
