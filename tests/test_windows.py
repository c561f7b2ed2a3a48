import pytest

import naive
from lexispectra.operators import windows as W
from lexispectra.operators.encoding import encode


@pytest.fixture(params=["one batch", "small batches"])
def batches(request, spark, monkeypatch):
    """Run with windows that cross many batch and step borders, too."""
    if request.param == "small batches":
        monkeypatch.setattr(W, "PAIRS_PER_STEP", 12)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def case(lines, vocab):
    texts = naive.corpus(2, lines=12)
    ids = naive.vocabulary(texts, 4)
    coded = encode(lines(texts), vocab(sorted(ids, key=ids.get)), ["line_key"])
    return texts, ids, coded


def test_positions(batches, case):
    texts, ids, coded = case
    found = {(r["line_key"], r["position"]): r["id"] for r in W.line_position(coded, ["line_key"]).collect()}
    expected = {(n, j): i for n, line in enumerate(naive.coded(texts, ids)) for j, i in enumerate(line, 1)}
    assert found == expected


def test_contexts(batches, case):
    texts, ids, coded = case
    rows = W.context_window(coded, 5, ["line_key"]).orderBy("line_key", "pos").collect()
    expected = [
        (n, i, line[max(0, j - 5) : j]) for n, line in enumerate(naive.coded(texts, ids)) for j, i in enumerate(line)
    ]
    assert [(r["line_key"], r["id"], r["context"]) for r in rows] == expected


def test_pairs(batches, case):
    texts, ids, coded = case
    found = sorted((r["left_id"], r["right_id"], r["distance"]) for r in W.window_pairs(coded, 4).collect())
    assert found == sorted(naive.pairs(texts, ids, 4))


def test_scattered_lines_are_refused(spark):
    rows = [(1, 0, 1), (2, 0, 1), (1, 1, 1)]
    coded = spark.createDataFrame(rows, "line_id BIGINT, pos INT, id INT").coalesce(1)
    with pytest.raises(Exception, match="not together and in order"):
        W.window_pairs(coded, 2).collect()


@pytest.mark.parametrize("window", [0, -1, 1.5, True])
def test_window_must_be_positive(case, window):
    with pytest.raises(ValueError):
        W.window_pairs(case[2], window)
