"""Word embeddings from co-occurrence statistics, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Send our task functions to the executors by value, so that the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lexispectra.metrics import RunMetrics  # noqa: E402
from lexispectra.operators.cooccurrence import count_cooccurrence  # noqa: E402
from lexispectra.operators.pmi import pmi  # noqa: E402
from lexispectra.operators.svd import svd  # noqa: E402
from lexispectra.operators.vocabulary import build_vocab  # noqa: E402
from lexispectra.plans.params import TrainParams  # noqa: E402
from lexispectra.plans.pipeline import (  # noqa: E402
    cooccurrence_files,
    embed,
    embed_files,
    statistics,
    train,
    train_files,
    vocabulary_files,
)

__all__ = [
    "RunMetrics",
    "TrainParams",
    "build_vocab",
    "cooccurrence_files",
    "count_cooccurrence",
    "embed",
    "embed_files",
    "pmi",
    "statistics",
    "svd",
    "train",
    "train_files",
    "vocabulary_files",
]
