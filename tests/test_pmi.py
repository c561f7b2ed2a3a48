import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

import naive
from lexispectra.metrics import RunMetrics
from lexispectra.operators import pmi as P
from lexispectra.operators.cooccurrence import count_cooccurrence, mirror
from lexispectra.plans.params import TrainParams
from lexispectra.plans.pipeline import pmi_cells
from lexispectra.plans.queries import rounded

CELLS = [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0)]
SCHEMA = "row INT, col INT, val DOUBLE"
EXPECTED = {
    (1, 1): math.log2(7 / 9),
    (1, 2): math.log2(14 / 9),
    (2, 1): math.log2(14 / 9),
    (2, 3): math.log2(7 / 3),
    (3, 2): math.log2(7 / 3),
}


def values(table):
    return {(r["row"], r["col"]): r["pmi"] for r in table.collect()}


@pytest.mark.parametrize("ids", [0, 3])
@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_worked_example(spark, monkeypatch, ids, symmetric, kind):
    monkeypatch.setattr(P, "BROADCAST_IDS", ids)
    cooc = spark.createDataFrame(CELLS, SCHEMA).withColumn("val", (F.col("val") * 2520).cast(kind))
    assert values(P.pmi(cooc, symmetric=symmetric)) == pytest.approx(EXPECTED)


def test_cutoff_then_shift(spark):
    found = values(P.pmi(spark.createDataFrame(CELLS, SCHEMA), cutoff=0, shift=2.5))
    assert found == pytest.approx({cell: v + 2.5 for cell, v in EXPECTED.items() if v >= 0})


def test_cutoff_is_inclusive_and_zero_is_kept(spark):
    cells = spark.createDataFrame([(1, 1, -2.5), (1, 2, -2.6), (2, 1, 0.5)], "row INT, col INT, pmi DOUBLE")
    found = values(P.pmi_shift(P.pmi_cutoff(cells, -2.5), 2.5))
    assert found == {(1, 1): 0.0, (2, 1): 3.0}


def test_scale_does_not_matter(spark):
    cooc = spark.createDataFrame(CELLS, SCHEMA)
    scaled = cooc.withColumn("val", F.col("val") * 2520)
    assert values(P.pmi(scaled)) == pytest.approx(EXPECTED)


def test_sums_agree(lines, vocab):
    texts = naive.corpus(7)
    ids = naive.vocabulary(texts, 3)
    cooc = count_cooccurrence(lines(texts), vocab(sorted(ids, key=ids.get)), 5, symmetric=False)
    total = P.cooc_total(cooc).first()["total"]
    assert P.row_marginal(cooc).agg(F.sum("row_total")).first()[0] == pytest.approx(total)
    assert P.col_marginal(cooc).agg(F.sum("col_total")).first()[0] == pytest.approx(total)
    shape = P.matrix_shape(cooc).first()
    assert (shape["n_rows"], shape["n_cols"]) <= (len(ids), len(ids))


@pytest.mark.parametrize("limits", [(3, 3), (0, 3), (0, 0)])
@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(36,18)"])
def test_pairs_once_give_the_cells_of_both_directions(spark, monkeypatch, limits, kind):
    for name, ids in zip(("BROADCAST_IDS", "LOOKUP_IDS"), limits):
        monkeypatch.setattr(P, name, ids)
    pairs = spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0), (2, 3, 1.0)], SCHEMA).withColumn("val", (F.col("val") * 2520).cast(kind))
    found = P.pmi(pairs, symmetric=True, mirrored=False)
    assert sorted(found.collect()) == sorted(P.pmi(mirror(pairs), symmetric=True).collect())
    assert values(found) == pytest.approx(EXPECTED)


def test_no_cell_is_shuffled_for_sums_too_many_to_broadcast(spark, monkeypatch, capsys):
    monkeypatch.setattr(P, "BROADCAST_IDS", 0)
    monkeypatch.setattr(P, "_read", {})
    pairs = spark.createDataFrame([(1, 1, 1), (7, 9, 2)], "row INT, col INT, val BIGINT")
    P.pmi(mirror(pairs), -2.5, 2.5, symmetric=True).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "inline" not in plan


def test_rounding_is_that_of_the_digits(spark):
    given = [0.0, -0.0, 1e-7, -4e-7, -6e-7, 0.1234565001, -0.1234564999, 2.5, -2.0000004, 17.9999996, -13.3333333333, 6.02214076]
    expected = [float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in given]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i INT, x DOUBLE").select("i", rounded(F.col("x"), 6).alias("x"))
    assert [r["x"] for r in table.orderBy("i").collect()] == expected


@pytest.mark.parametrize("mirrored", [False, True])
def test_pairs_once_and_their_cells_kept(spark, mirrored):
    pairs = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 3, 2), (3, 3, 1)], "row INT, col INT, val BIGINT")
    cooc = mirror(pairs) if mirrored else pairs
    whole = {(r["row"], r["col"]): r["pmi"] for r in P.pmi(mirror(pairs), symmetric=True).collect()}
    found = {(r["row"], r["col"]): r["pmi"] for r in P.pmi(cooc, symmetric=True, mirrored=mirrored, once=True).collect()}
    assert found == pytest.approx({k: v for k, v in whole.items() if k[0] <= k[1]}) and len(found) == 4
    metrics = RunMetrics()
    pmi_cells(cooc, TrainParams(pmi_cutoff=None, pmi_shift=None), True, metrics, mirrored, once=True).collect()
    assert metrics.values() == {"cells_kept": len(whole)}
    with pytest.raises(ValueError, match="symmetric"):
        P.pmi(cooc, once=True)
