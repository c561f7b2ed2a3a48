"""Weighted co-occurrence counts: ``row INT, col INT, val DOUBLE``, one row per cell, ids from 1."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispectra.functions.weights import FIXED_DIGITS, exact_units, fixed_weights, weighting_code
from lexispectra.operators.borders import border_pairs, is_cut
from lexispectra.operators.encoding import BROADCAST_BYTES, encode
from lexispectra.operators.pair_sums import add_packed, choose_bands, pack_pairs
from lexispectra.operators.windows import check_window

# Cells whose weights have no small denominator: two digits are left for sums of them, 18 for whole numbers.
FIXED_CELL = T.DecimalType(38 - 2, FIXED_DIGITS)
_HALF_DIGITS = FIXED_DIGITS // 2


def count_cooccurrence(
    lines: DataFrame,
    vocab: DataFrame,
    window: int = 10,
    weighting: int | str = 1,
    symmetric: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sum the distance weights of all pairs within ``window`` words on a line.

    Words outside the vocabulary are skipped before distances are taken. With
    ``symmetric`` each pair counts in both directions (twice on the diagonal),
    otherwise only with the left word as the row.
    """
    cells, denominator = cooccurrence_units(lines, vocab, window, weighting, symmetric, broadcast_bytes)
    return cells.withColumn("val", F.col("val") / F.lit(float(denominator)))


def cooccurrence_units(
    lines: DataFrame,
    vocab: DataFrame,
    window: int,
    weighting: int | str,
    symmetric: bool,
    broadcast_bytes: int = BROADCAST_BYTES,
    mirrored: bool = True,
) -> tuple[DataFrame, int]:
    """The counts times a common denominator, and that denominator.

    Scaled counts are BIGINT wherever the weights allow it and decimals of 18 places
    elsewhere, so sums over them are exact and the same in any order. Values that depend only on ratios, such as PMI, can use them
    directly. Without ``mirrored`` a symmetric table has each unordered pair once, to be
    merged before `mirror`. Lines in segments (see `sources.pieces`) count as whole lines.
    """
    found, denominator = _sums_by_corpus([lines], vocab, window, weighting, symmetric, broadcast_bytes)
    cells = found.select("row", "col", _value("sums", 0, _kinds(weighting, window)).alias("val"))
    return (mirror(cells) if symmetric and mirrored else cells), denominator


def _kinds(weighting: int | str, window: int) -> int:
    """Sums that make up a weight: one, or two halves of a decimal."""
    return 2 if exact_units(weighting, window) is None else 1


def _sums_by_corpus(
    corpora: Sequence[DataFrame], vocab: DataFrame, window: int, weighting: int | str, symmetric: bool, broadcast_bytes: int
) -> tuple[DataFrame, int]:
    """``row, col, sums`` with the sums of each corpus in turn, and their denominator; all corpora meet in one shuffle."""
    check_window(window)
    if not corpora:
        raise ValueError("nothing to count")
    code = weighting_code(weighting)
    units, bands = exact_units(code, window), choose_bands(corpora, window)
    worth = _halves(fixed_weights(code, window)) if units is None else [units.per_distance]
    none = [[0] * window] * len(worth)

    def packed(n: int, corpus: DataFrame) -> DataFrame:
        across = _pair_cells(border_pairs(corpus, vocab, window, broadcast_bytes), symmetric) if is_cut(corpus) else None
        own = [*none * n, *worth, *none * (len(corpora) - n - 1)]
        return pack_pairs(encode(corpus, vocab, broadcast_bytes=broadcast_bytes), window, own, symmetric, bands, across)

    found = add_packed(reduce(DataFrame.unionByName, [packed(n, c) for n, c in enumerate(corpora)]), bands)
    return found, 1 if units is None else units.denominator


def _value(sums: str, n: int, kinds: int) -> Column:
    """The sum of the corpus ``n``."""
    return F.col(sums)[n] if kinds == 1 else _joined(sums, 2 * n)


def _pair_cells(pairs: DataFrame, symmetric: bool) -> DataFrame:
    """Pairs as ``row, col, distance``; in the symmetric form the smaller id is the row."""
    ends = (F.least("left_id", "right_id"), F.greatest("left_id", "right_id")) if symmetric else (F.col("left_id"), F.col("right_id"))
    return pairs.select(ends[0].alias("row"), ends[1].alias("col"), "distance")


def _halves(weights: Sequence[Decimal]) -> list[list[int]]:
    """Decimals as whole numbers of `_HALF_DIGITS` digits, the upper half and the lower one, so that BIGINT sums of either are exact."""
    whole = [int(w.scaleb(FIXED_DIGITS)) for w in weights]
    return [[w // 10**_HALF_DIGITS for w in whole], [w % 10**_HALF_DIGITS for w in whole]]


def _joined(sums: str, n: int) -> Column:
    """Sums of both halves, the first at place ``n``, as one decimal."""
    upper = F.col(sums)[n].cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-_HALF_DIGITS))
    lower = F.col(sums)[n + 1].cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-FIXED_DIGITS))
    return (upper.cast(FIXED_CELL) + lower.cast(FIXED_CELL)).cast(FIXED_CELL)


def mirror(cells: DataFrame) -> DataFrame:
    """Unordered pairs to both directions; a pair of equal words counts twice in its one cell."""
    row, col, val = F.col("row"), F.col("col"), F.col("val")
    twice = (val + val).cast(cells.schema["val"].dataType)
    return both_ways(cells).select(
        either_way(row, col).alias("row"), either_way(col, row).alias("col"), F.when(row == col, twice).otherwise(val).alias("val")
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair as it is and, unless its words are equal, once more with ``turned`` set."""
    # A flag is dealt out and not structs, which Spark would build as objects for every pair.
    ways = pairs.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True))))
    return ways.where(~F.col("turned") | (F.col("row") != F.col("col")))


def either_way(straight: Column, turned: Column) -> Column:
    """What stands in a cell of `both_ways`."""
    return F.when(F.col("turned"), turned).otherwise(straight)


def count_corpora(
    corpora: Sequence[DataFrame],
    vocab: DataFrame,
    window: int = 10,
    weighting: int | str = 1,
    symmetric: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Counts of several corpora under one vocabulary, as their tables of counts would add up; pairs are mirrored last."""
    found, denominator = _sums_by_corpus(corpora, vocab, window, weighting, symmetric, broadcast_bytes)
    kinds = _kinds(weighting, window)
    counts = [_value("sums", n, kinds) / F.lit(float(denominator)) for n in range(len(corpora))]
    cells = found.select("row", "col", reduce(lambda a, b: a + b, counts).alias("val"))
    return mirror(cells) if symmetric else cells


def merge_cooccurrence(*tables: DataFrame) -> DataFrame:
    """Add up count tables that were made with one vocabulary; also removes duplicate cells."""
    if not tables:
        raise ValueError("nothing to merge")
    together = reduce(DataFrame.unionByName, tables)
    total = F.sum("val")
    if together.schema["val"].dataType == FIXED_CELL:
        total = total.cast(FIXED_CELL)
    return together.groupBy("row", "col").agg(total.alias("val"))
