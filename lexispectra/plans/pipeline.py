"""From corpus to word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.metrics import RunMetrics
from lexispectra.operators.cooccurrence import cooccurrence_units, merge_cooccurrence, mirror
from lexispectra.operators.pmi import matrix_shape, pmi
from lexispectra.operators.svd import embedding, svd
from lexispectra.operators.vocabulary import build_vocab, word_count
from lexispectra.plans.params import TrainParams
from lexispectra.runtime import clear_outputs, stage
from lexispectra.sources.cooccurrence import read_cooccurrence_bin, write_cooccurrence_bin
from lexispectra.sources.embedding import write_embedding
from lexispectra.sources.pieces import read_corpus_files
from lexispectra.sources.vocabulary import read_vocabulary, write_vocabulary


def train(
    lines: DataFrame, params: TrainParams = TrainParams(), vocab: DataFrame | None = None, metrics: RunMetrics | None = None
) -> DataFrame:
    """Corpus lines to ``id INT, word STRING, vector ARRAY<DOUBLE>``.

    With a given ``vocab`` the limits on count and size are not applied to it. ``metrics`` holds the sizes
    along the way when the function returns.
    """
    if vocab is None:
        vocab = build_vocab(lines, params.min_count, params.max_vocab, metrics)
    counts = staged_counts(lines, vocab, params, metrics, mirrored=False)[0]
    return _embed_counts(counts, vocab, params, params.symmetric, metrics, mirrored=not params.symmetric)


def embed(
    cooc: DataFrame, vocab: DataFrame, params: TrainParams = TrainParams(), unique: bool = False, symmetric: bool = False
) -> DataFrame:
    """The same from a co-occurrence table.

    The table may list a cell more than once unless it is ``unique``; one known to be ``symmetric``
    needs no column sums.
    """
    cells = cooc.select("row", "col", "val") if unique else merge_cooccurrence(cooc)
    return _embed_counts(stage(cells, "cooccurrence"), vocab, params, symmetric)


def train_files(
    spark: SparkSession,
    corpus: str | list[str],
    output: str,
    params: TrainParams = TrainParams(),
    vocab_in: str | None = None,
    vocab_out: str | None = None,
    cooccurrence_out: str | None = None,
    encoding: str | None = None,
    overwrite: bool = False,
    metrics: RunMetrics | None = None,
) -> None:
    """Text files to an embedding file; uses a vocabulary file or writes the one it makes, keeps the counts if asked.

    ``metrics`` as in `train`. Outputs that exist are refused before any work, or replaced with ``overwrite``.
    """
    clear_outputs(spark, [output, vocab_out if vocab_in is None else None, cooccurrence_out], overwrite)
    lines = read_corpus_files(spark, corpus, encoding)
    if vocab_in is not None:
        vocab = read_vocabulary(spark, vocab_in, encoding)
    else:
        vocab = build_vocab(lines, params.min_count, params.max_vocab, metrics)
        if vocab_out is not None:
            write_vocabulary(vocab, vocab_out, encoding)
    counts, denominator = staged_counts(lines, vocab, params, metrics, mirrored=False)
    if cooccurrence_out is not None:
        values = counts.withColumn("val", F.col("val") / F.lit(float(denominator)))
        write_cooccurrence_bin(values, cooccurrence_out, once=params.symmetric)
    found = _embed_counts(counts, vocab, params, params.symmetric, metrics, mirrored=not params.symmetric)
    write_embedding(found, output, encoding)


def embed_files(
    spark: SparkSession,
    cooccurrence: str,
    vocab: str,
    output: str,
    params: TrainParams = TrainParams(),
    encoding: str | None = None,
    overwrite: bool = False,
) -> None:
    """Binary co-occurrence and vocabulary files to an embedding file."""
    clear_outputs(spark, [output], overwrite)
    words = read_vocabulary(spark, vocab, encoding)
    write_embedding(embed(read_cooccurrence_bin(spark, cooccurrence), words, params, unique=True), output, encoding)


def vocabulary_files(
    spark: SparkSession,
    corpus: str | list[str],
    vocab_out: str,
    min_count: int = 10,
    max_vocab: int = 0,
    encoding: str | None = None,
    overwrite: bool = False,
) -> None:
    """Text files to a vocabulary file alone."""
    clear_outputs(spark, [vocab_out], overwrite)
    write_vocabulary(build_vocab(read_corpus_files(spark, corpus, encoding), min_count, max_vocab), vocab_out, encoding)


def cooccurrence_files(
    spark: SparkSession,
    corpus: str | list[str],
    vocab: str,
    output: str,
    window: int = 10,
    weighting: int | str = 1,
    symmetric: bool = True,
    encoding: str | None = None,
    overwrite: bool = False,
) -> None:
    """Text files and a vocabulary file to a binary count file alone."""
    clear_outputs(spark, [output], overwrite)
    words = read_vocabulary(spark, vocab, encoding)
    cells, denominator = cooccurrence_units(read_corpus_files(spark, corpus, encoding), words, window, weighting, symmetric, mirrored=False)
    write_cooccurrence_bin(cells.withColumn("val", F.col("val") / F.lit(float(denominator))), output, once=symmetric)


def statistics(lines: DataFrame, vocab: DataFrame, cells: DataFrame, cutoff: float | None = None) -> DataFrame:
    """``metric STRING, value BIGINT``: sizes along the way, from the corpus, its vocabulary and the PMI of all cells."""

    def rows(table: DataFrame, **found) -> DataFrame:
        metrics = F.array(*[
            F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value")) for name, value in found.items()
        ])
        return table.agg(metrics.alias("found")).select(F.inline("found"))

    kept = F.count("*") if cutoff is None else F.count_if(F.col("pmi") >= cutoff)
    return (
        rows(word_count(lines), tokens=F.sum("count"), distinct_words=F.count("*"))
        .unionByName(rows(vocab, vocabulary=F.count("*"), tokens_in_vocabulary=F.sum("count")))
        .unionByName(rows(cells, cells=F.count("*"), cells_kept=kept))
    )


def pmi_cells(
    cooc: DataFrame, params: TrainParams, symmetric: bool, metrics: RunMetrics | None = None, mirrored: bool = True, once: bool = False
) -> DataFrame:
    """The PMI table of a staged count table, with the cutoff and shift of ``params``; with ``once`` each pair of a symmetric one once."""
    cells = pmi(cooc, params.pmi_cutoff, params.pmi_shift, symmetric, mirrored, once)
    return cells if metrics is None else metrics.watch(cells, cells_kept=F.sum(_cells_of_pair()) if once else F.count("*"))


def _cells_of_pair() -> Column:
    """Cells of a symmetric table that an unordered pair stands for."""
    return F.when(F.col("row") == F.col("col"), 1).otherwise(2)


def staged_counts(
    lines: DataFrame, vocab: DataFrame, params: TrainParams, metrics: RunMetrics | None = None, mirrored: bool = True
) -> tuple[DataFrame, int]:
    """The counts of `cooccurrence_units` as a staged table; of a symmetric one each pair is stored once and, if ``mirrored``, mirrored when it is read."""
    cells, denominator = cooccurrence_units(lines, vocab, params.window, params.weighting, params.symmetric, mirrored=False)
    if metrics is not None:
        cells = metrics.watch(cells, cells=F.sum(_cells_of_pair() if params.symmetric else F.lit(1)))
    cells = stage(cells, "cooccurrence")
    return (mirror(cells) if params.symmetric and mirrored else cells), denominator


def _embed_counts(
    cooc: DataFrame, vocab: DataFrame, params: TrainParams, symmetric: bool, metrics: RunMetrics | None = None, mirrored: bool = True
) -> DataFrame:
    # PMI depends on ratios only, so counts in units of their denominator will do and sum exactly.
    shape, last = matrix_shape(cooc).first(), vocab.agg(F.max("id")).first()[0] or 0
    if max(shape["n_rows"] or 0, shape["n_cols"] or 0) > last:
        raise ValueError(f"the counts have ids up to {max(shape)}, the vocabulary only up to {last}")
    cells = pmi_cells(cooc, params, symmetric, metrics, mirrored, once=symmetric)
    found = svd(cells, params.dimension, method=params.method, symmetric=symmetric)
    return embedding(vocab, found.vectors, params.dimension)
