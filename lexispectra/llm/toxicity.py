"""Toxicity: subword embeddings averaged over windows of words into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.text import Block, blocks, groups, mix

BUCKETS_LOG2, DIMENSION = 18, 8
BUCKETS = 1 << BUCKETS_LOG2
SIZES = (3, 4, 5)
#: Words averaged at once; a text's score is that of its worst window.
WINDOW = 24
#: An average is taken over so many n-grams at least; missing ones are neutral.
LEAST = 96
#: Bound of the labelled rows that the model learns from, by class: those with the smallest hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 1500, 4500
EPOCHS, STEPS, BATCH, RATE, FLOOR = 4, 1200, 256, 2.0, 0.1
_BLOCK = 1 << 20
_STEP = np.uint64(0x100000001B3)


def windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Window number of every word, and document of every window; a text's last words join its last whole window."""
    n = np.diff(block.first)
    count = np.maximum(n // WINDOW, (n > 0).astype(np.int64))
    inside = np.arange(len(block.doc)) - block.first[block.doc]
    first = np.cumsum(count) - count
    window = first[block.doc] + np.minimum(inside // WINDOW, count[block.doc] - 1)
    return window, np.repeat(np.arange(len(block)), count)


def subwords(block: Block, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and bucket of every character n-gram (in bytes, with word ends marked) and whole word.

    Each distinct word of a window counts once, so that a text of one repeated word is not all that word.
    """
    order, new = groups(window, block.words)
    kept = np.sort(order[new])
    starts, ends = (x[kept] + block.doc[kept] + 1 for x in block.bounds)
    spaced = np.insert(np.where(block.in_word, block.data, 32), block.offsets, 32).astype(np.uint64)
    spaced = np.append(spaced, np.full(max(SIZES), 32, np.uint64))
    size = ends - starts + 1  # n-grams may begin at the mark before the word and at each of its bytes
    word = np.repeat(np.arange(len(kept)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size - starts + 1, size)
    room = ends[word] + 1 - at
    words, found = [np.arange(len(kept))], [block.words[kept]]
    hashed = spaced.copy()
    for n in range(2, max(SIZES) + 1):
        hashed[: len(hashed) - n + 1] = hashed[: len(hashed) - n + 1] * _STEP + spaced[n - 1 :]
        if n in SIZES:
            fits = room >= n
            words.append(word[fits])
            found.append(hashed[at[fits]] + np.uint64(n))
    buckets = mix(np.concatenate(found)) >> np.uint64(64 - BUCKETS_LOG2)
    return window[kept][np.concatenate(words)], buckets.astype(np.int64)


class Classifier:
    """softmax(W . mean of embeddings + b), trained jointly by Adagrad."""

    def __init__(self) -> None:
        random = np.random.default_rng(5)
        self.vectors = np.zeros((BUCKETS, DIMENSION), np.float32)  # an unseen n-gram says nothing
        self.weights = random.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self._squares = [np.full(p.shape, FLOOR, np.float32) for p in (self.vectors, self.weights, self.bias)]

    def step(self, buckets: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> None:
        """One batch: the buckets of its windows, where each begins, and their labels."""
        size = np.diff(np.append(starts, len(buckets)))
        n = np.maximum(size, LEAST)
        mean = np.add.reduceat(self.vectors[buckets], starts, axis=0) / n[:, None]
        scores = mean @ self.weights + self.bias
        odds = np.exp(scores - scores.max(1, keepdims=True))
        off = odds / odds.sum(1, keepdims=True)
        off[np.arange(len(toxic)), toxic] -= 1
        back = np.repeat((off @ self.weights.T) / n[:, None], size, axis=0)
        touched, slot = np.unique(buckets, return_inverse=True)
        grad = np.stack([np.bincount(slot, back[:, k], len(touched)) for k in range(DIMENSION)], 1)
        squares = self._squares[0]
        squares[touched] += grad * grad
        self.vectors[touched] -= RATE * grad / np.sqrt(squares[touched])
        for part, g, squares in ((self.weights, mean.T @ off, self._squares[1]), (self.bias, off.sum(0), self._squares[2])):
            squares += g * g
            part -= RATE * g / np.sqrt(squares)

    def margins(self) -> np.ndarray:
        """Toxic minus clean score of every bucket: averaging and the linear layer commute."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


@dataclass(frozen=True)
class Model:
    """Margin of every bucket and offset of a window, and the line from a text's worst window to its log odds."""

    margins: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, block: Block) -> np.ndarray:
        """Score of each text by its worst window; a text without words has the lowest score there is, 0."""
        block = block.lower()
        window, doc = windows(block)
        owner, buckets = subwords(block, window)
        sizes = np.bincount(owner, minlength=len(doc))
        total = np.bincount(owner, self.margins[buckets], len(doc))
        worst = np.full(len(block), -np.inf)
        np.maximum.at(worst, doc, total / np.maximum(sizes, LEAST) + self.offset)
        return np.where(np.isfinite(worst), _sigmoid(self.slope * worst + self.shift), 0.0)


def _calibrate(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the worst window's margin, by Newton's method with a small ridge."""
    x = np.stack([np.clip(worst, -30, 30), np.ones(len(worst))], 1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ line)
        slope = x.T @ (p - toxic) + 0.1 * (line - (1.0, 0.0))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        line = line - step / max(1.0, np.abs(step).max())
    return (float(line[0]), float(line[1])) if np.isfinite(line).all() and line[0] > 0 else (1.0, 0.0)


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """Learn from whole texts in the order given; every fourth one is kept back to turn margins into odds.

    A toxic text need not be toxic in each window: after the first pass only the windows
    that score above one half, and the worst of each text, count as toxic, and the rest of such a text is left out.
    """
    classifier, data, base = Classifier(), [], 0
    for block in blocks(pa.array(texts, pa.string()), _BLOCK):
        block = block.lower()
        window, doc = windows(block)
        owner, buckets = subwords(block, window)
        order = np.argsort(owner, kind="stable")
        data.append((buckets[order].astype(np.int32), np.bincount(owner, minlength=len(doc)), doc + base))
        base += len(block)
    if not sum(len(d[2]) for d in data) or len(set(toxic.tolist())) < 2:
        rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))), 1.0, 0.0)
    buckets, sizes, doc = (np.concatenate(x) for x in zip(*data))
    starts = np.cumsum(sizes) - sizes
    label = toxic[doc].astype(np.int64)
    learnt = doc % 4 < 3
    use = learnt
    random = np.random.default_rng(9)
    worst = np.full(base, -np.inf)
    passes = max(EPOCHS, min(40, -(-STEPS * BATCH // int(learnt.sum()))))  # few texts are read more often
    for _ in range(passes):
        chosen = random.permutation(np.flatnonzero(use))
        for i in range(0, len(chosen), BATCH):
            batch = chosen[i : i + BATCH]
            n = sizes[batch]
            first = np.cumsum(n) - n
            places = np.arange(n.sum()) + np.repeat(starts[batch] - first, n)
            classifier.step(buckets[places], first, label[batch])
        margins, offset = classifier.margins(), classifier.offset()
        scores = np.add.reduceat(margins[buckets].astype(np.float64), starts) / np.maximum(sizes, LEAST) + offset
        worst[:] = -np.inf
        np.maximum.at(worst, doc, scores)
        use = learnt & ((label == 0) | (scores >= 0) | (scores == worst[doc]))
    kept = np.flatnonzero(np.isfinite(worst) & (np.arange(base) % 4 == 3))
    return Model(margins, offset, *_calibrate(worst[kept], toxic[kept]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _sample(rows: DataFrame, order: list) -> DataFrame:
    """At most TOXIC_ROWS and CLEAN_ROWS rows of either label, the first in ``order``."""
    parts = [rows.where(F.col("_label") == label).orderBy(*order).limit(n) for label, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    return parts[0].unionByName(parts[1])


def fit(texts: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows in one task.

    ``texts`` has _id and _text, ``labels`` _id and _label; labels other than 0 and 1 are left out. The
    sample is drawn from the labels by a hash of the id, so only its ids go to all tasks
    and only its texts are moved; ids that are repeated cannot make it larger.
    """
    mixed = F.xxhash64(F.col("_id").cast("string"), F.lit(17))
    chosen = _sample(labels.distinct(), [mixed, "_id"])
    known = texts.join(F.broadcast(chosen), "_id").select(mixed.alias("mixed"), F.col("_text").alias("text"), F.col("_label").cast("int").alias("_label"))
    sample = _sample(known, ["mixed", "text"]).withColumnRenamed("_label", "toxic")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["mixed", "text"], na_position="first")
        model = train(frame["text"].tolist(), frame["toxic"].to_numpy())
        return pd.DataFrame({"margins": [model.margins.tobytes()], "offset": [model.offset], "slope": [model.slope], "shift": [model.shift]})

    schema = "margins BINARY, offset DOUBLE, slope DOUBLE, shift DOUBLE"
    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, schema).collect()
    if not found:
        return train([], np.zeros(0))
    row = found[0]
    return Model(np.frombuffer(row["margins"], np.float32), row["offset"], row["slope"], row["shift"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """held_out, score and predicted of every row, learnt from labels outside the held-out fold.

    Rows are scored one by one from their text alone, so repeated rows stay; null and
    empty texts score 0. Without labels of both classes every text with a word gets the
    share of toxic labels, 0.01 at least.
    """
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(~held_out(F.col("_id")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, ids))
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            scores = [fitted.score(block) for block in blocks(batch.column("_text"), _BLOCK)]
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.concatenate(scores))], ["id", "score"])

    scored = texts.mapInArrow(apply, f"id {kind}, score DOUBLE")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
