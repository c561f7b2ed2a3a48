"""Log-bilinear language model: trained by noise-contrastive estimation, normalised by matrix products."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.text import Block, blocks, groups, mix
from lexispectra.runtime import stage

#: Frequent words with a class of their own, and classes by their last bytes of the words without vectors.
WORDS, ENDINGS = 448, 64
CLASSES = WORDS + ENDINGS
#: Other words have vectors of their own from this count on: LEAST, or ROOT times the square root of the tokens.
LEAST, ROOT = 10, 0.01
DIMENSION, CONTEXT = 16, 2
#: Most frequent words whose counts go to every task; the counts of all others are joined.
HEAD = 1 << 17
#: Most words with vectors of their own (132 bytes each); in a corpus where more reach that count, it rises.
MOST_OWN = 1 << 20
#: Tokens that one copy of the model learns from, and copies or sums that one task adds up.
COPY_TOKENS, FAN_IN = 1 << 22, 16
#: Contexts whose scores are held at a time, so that they stay in the cache.
SCORED = 128
#: Most frequent inputs, of whose pairs a task knows all normalisers (64 MB), and the smallest sum that is taken from them.
FREQUENT, LEAST_SUM = 4096, 1e-25
BATCH, NOISE, RATE, ROUNDS = 1024, 64, 0.1, 1
#: Own words that are taught together for each group there is, noise words for those of one group, and rows of a model that travel together.
LESSON, GROUP_NOISE, CHUNK = 256, 32, 4096
#: The end of a document as a word hash; also what stands before its first word.
_END = np.uint64(0xE2D0F7E87)
_LOG10 = np.log(10.0)
#: Ending class by the last byte of a word times 256 and the one before it.
_ENDING_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)
#: Bytes of text that are scored together.
_SCORED_BYTES = 1 << 21


@dataclass
class Vocabulary:
    """Counts over the training tokens: the head by sorted hash, and sums for all of them.

    Classes are the WORDS most frequent words, the ENDINGS, then the groups. A group has the own
    words ``starts[g]`` to ``starts[g + 1]``, whose counts are ``own_counts``; ``own`` is the number of a head word among them, or -1.
    """

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    distinct: int
    ending_tokens: np.ndarray
    ending_words: np.ndarray
    class_tokens: np.ndarray
    own: np.ndarray
    own_counts: np.ndarray
    starts: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        """Numbers of classes and of own words."""
        return len(self.class_tokens), len(self.own_counts)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the head, and whether it is there."""
        at = np.minimum(np.searchsorted(self.hashes, words), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == words if len(self.hashes) else np.zeros(len(words), bool)

    def classes_of(self, words: np.ndarray, endings: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return (WORDS + endings).astype(np.int64)
        own = self.classes[at]
        return np.where(known & (own >= 0), own, WORDS + endings).astype(np.int64)

    def own_of(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Number of each word among the own words of the groups, or -1."""
        return np.where(known, self.own[at], -1).astype(np.int64) if len(self.hashes) else np.full(len(at), -1, np.int64)

    def inputs(self, classes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Row of each word's input vector: its class, or for an own word one after all classes."""
        return np.where(own >= 0, len(self.class_tokens) + own, classes)


def _endings(block: Block) -> np.ndarray:
    """Class of each word by its last two bytes, punctuation and digits left as they are."""
    starts, ends = block.bounds
    last = block.data[ends - 1].astype(np.int64)
    before = block.data[np.maximum(ends - 2, starts)]
    return _ENDING_OF[last * 256 + before]


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of every token, each document closed by an end; and its document."""
    ends = block.first[1:]
    words = np.insert(block.words, ends, _END)
    return words, np.insert(_endings(block), ends, 0), np.insert(block.doc, ends, np.arange(len(block)))


def _context(classes: np.ndarray, doc: np.ndarray, end_class: int) -> np.ndarray:
    """The classes before each token, nearest first; before the first word stand ends."""
    before = np.full((CONTEXT, len(classes)), end_class, np.int64)
    for k in range(1, CONTEXT + 1):
        before[k - 1, k:] = np.where(doc[k:] == doc[:-k], classes[:-k], end_class)
    return before


class Model:
    """score(w | context) = q_w . sum_i C_i r_i + b_w, over classes, and over the own words of each group."""

    def __init__(self, flat: np.ndarray, classes: int = CLASSES, words: int = 0) -> None:
        self.classes, self.words = classes, words
        self.parts, at = [], 0
        for shape in self.shapes(classes, words):
            size = int(np.prod(shape))
            self.parts.append(np.array(flat[at : at + size], np.float32).reshape(shape))
            at += size
        self._products: list[np.ndarray] | None = None

    @staticmethod
    def shapes(classes: int, words: int) -> tuple:
        """Input vectors, C, and q and b of classes and of own words."""
        return ((classes + words, DIMENSION), (CONTEXT, DIMENSION, DIMENSION), (classes, DIMENSION), (classes,), (words, DIMENSION), (words,))

    @classmethod
    def start(cls, class_tokens: np.ndarray, own_counts: np.ndarray = np.zeros(0)) -> Model:
        """Small random vectors, and the unigram model as bias."""
        random = np.random.default_rng(7)
        classes, words = len(class_tokens), len(own_counts)
        size = sum(int(np.prod(s)) for s in cls.shapes(classes, words)[:3])
        log = np.log((class_tokens + 1.0) / (class_tokens + 1.0).sum())
        flat = np.concatenate([random.normal(0, 0.1, size), log, np.zeros(words * DIMENSION), np.log(own_counts)])
        model = cls(flat, classes, words)
        model.parts[1][:] = np.eye(DIMENSION, dtype=np.float32) / CONTEXT
        return model

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts])

    def predict(self, before: np.ndarray) -> np.ndarray:
        r, c = self.parts[:2]
        if self._products is not None:
            return sum(p.take(before[i], 0) for i, p in enumerate(self._products))
        return sum(r.take(before[i], 0) @ c[i] for i in range(CONTEXT))

    def settle(self) -> Model:
        """Multiply all inputs once; the model must not be taught any more."""
        r, c = self.parts[:2]
        self._products = [r @ c[i] for i in range(CONTEXT)]
        return self

    def log_probabilities(self, before: np.ndarray, target: np.ndarray, frequent: Normalisers | None = None, predicted: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the normalised probability of each target class.

        The normaliser depends on the context alone, so it is looked up among those of ``frequent`` inputs, or else taken
        once for each distinct context, in batches of matrix products. ``predicted`` are the vectors of all contexts, if known.
        """
        _, _, q, b, _, _ = self.parts
        predicted = self.predict(before) if predicted is None else predicted
        normaliser = np.full(len(target), np.nan, np.float32) if frequent is None else frequent.find(before)
        rest = np.flatnonzero(np.isnan(normaliser))
        others = before[:, rest]
        key = others[0]
        for i in range(1, CONTEXT):
            key = key * (self.classes + self.words) + others[i]
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        scorer, found = _with_bias(q, b), np.empty(len(distinct), np.float32)
        for i in range(0, len(distinct), SCORED):
            found[i : i + SCORED] = _log_sum(predicted.take(rest[first[i : i + SCORED]], 0), scorer)
        normaliser[rest] = found[back]
        out = np.empty(len(target), np.float64)
        for i in range(0, len(target), 1 << 16):
            at = slice(i, i + (1 << 16))
            t = target[at]
            out[at] = np.einsum("ij,ij->i", predicted[at], q.take(t, 0)) + b[t] - normaliser[at]
        return out

    def own_log_probabilities(self, before: np.ndarray, own: np.ndarray, starts: np.ndarray, predicted: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of each own word within its group, normalised over the group."""
        wq, wb = self.parts[4:]
        predicted = self.predict(before) if predicted is None else predicted
        out = np.einsum("ij,ij->i", predicted, wq.take(own, 0)).astype(np.float64) + wb[own]
        for g, rows in _by_group(own, starts):
            group = slice(starts[g], starts[g + 1])
            out[rows] -= _log_sum(predicted.take(rows, 0), _with_bias(wq[group], wb[group]))
        return out


class Normalisers:
    """Log normalisers of all contexts of frequent inputs, for contexts of two.

    A score is a sum over the words of the context, so its exponential is a product of one number for each of them, and the
    sums over all classes are one matrix product. Sums too small for 32 bits are left to `Model.log_probabilities`.
    """

    def __init__(self, model: Model, counts: np.ndarray, most: int = FREQUENT) -> None:
        r, c, q, b = model.parts[:4]
        top = np.argsort(-counts, kind="stable")[:most]
        self._place = np.full(len(counts), -1, np.int32)
        self._place[top] = np.arange(len(top))
        factors, peaks = [], []
        for i, bias in enumerate((np.float32(0), b)):
            scores = (r[top] @ c[i]) @ q.T + bias
            peaks.append(scores.max(1))
            factors.append(np.exp(scores - peaks[-1][:, None]))
        self._logs = np.empty((len(top), len(top)), np.float32)
        for i in range(0, len(top), SCORED):
            sums = factors[0][i : i + SCORED] @ factors[1].T
            sums[~((sums >= LEAST_SUM) & (sums < np.inf))] = np.nan
            self._logs[i : i + SCORED] = np.log(sums) + peaks[0][i : i + SCORED, None] + peaks[1]

    def find(self, before: np.ndarray) -> np.ndarray:
        """The normaliser of each context, or NaN."""
        first, second = self._place[before[0]], self._place[before[1]]
        found = np.full(before.shape[1], np.nan, np.float32)
        held = np.flatnonzero((first >= 0) & (second >= 0))
        found[held] = self._logs[first[held], second[held]]
        return found


# The normalisers of the model that this Python worker scored by last.
_known: dict[int, Normalisers] = {}


def _normalisers(model: Model, vocab: Vocabulary, flat: np.ndarray) -> Normalisers:
    name = zlib.crc32(flat.tobytes())
    if name not in _known:
        _known.clear()
        # Groups are never inputs, only their words.
        _known[name] = Normalisers(model, np.concatenate([vocab.class_tokens[:CLASSES], np.zeros(len(vocab.class_tokens) - CLASSES), vocab.own_counts]))
    return _known[name]


def _with_bias(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([q, b]).T)


def _log_sum(predicted: np.ndarray, scorer: np.ndarray) -> np.ndarray:
    """Log of the sum of exp over all scores; only where that leaves the range of the numbers are scores taken relative to the largest."""
    one = np.ones((len(predicted), 1), np.float32)
    whole = np.concatenate([predicted, one], axis=1)  # the last row of the scorer is the bias
    scores = whole @ scorer
    with np.errstate(over="ignore", divide="ignore"):
        np.exp(scores, out=scores)
        found = np.log(scores @ np.ones(scores.shape[1], np.float32))
    if not np.isfinite(found).all():
        scores = whole @ scorer
        top = scores.max(1)
        found = top + np.log(np.exp(scores - top[:, None]).sum(1))
    return found


def _by_group(own: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that occurs, and the places of its words, BATCH at most at a time."""
    group = np.searchsorted(starts, own, "right") - 1
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(len(starts)))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        for i in range(ends[g], ends[g + 1], BATCH):
            yield g, order[i : min(i + BATCH, ends[g + 1])]


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.add.reduceat(values.take(order, 0), starts, axis=0)


def _climb(part: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
    """A step of Adagrad on some rows."""
    held = squares.take(at, 0)
    held += grad * grad
    squares[at] = held
    part[at] = part.take(at, 0) + RATE * grad / np.sqrt(held)


def _push(scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Minus the logistic function of scores and bias, in place."""
    scores += bias
    np.negative(scores, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.divide(np.float32(-1), scores, out=scores)


class Trainer:
    """Noise-contrastive estimation with Adagrad; a batch shares its noise words."""

    def __init__(self, model: Model, class_tokens: np.ndarray, seed: int, own_counts: np.ndarray = np.zeros(0), starts: np.ndarray = np.zeros(1, np.int64)) -> None:
        self.model = model
        self._noise = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
        self._cumulative = np.cumsum(self._noise)
        self._log = np.log(NOISE * self._noise).astype(np.float32)
        self._squares = [np.full(p.shape, 1e-6, np.float32) for p in model.parts[:4]]
        # Gradients of own words are sums over their few occurrences, so that a rare word moves little.
        self._own_squares = [np.ones(p.shape, np.float32) for p in model.parts[4:]]
        self._starts, self._own_cumulative = starts, np.append(0, np.cumsum(own_counts))
        totals = np.repeat(np.diff(self._own_cumulative[starts]), np.diff(starts))
        self._own_log = np.log(GROUP_NOISE * own_counts / totals).astype(np.float32)
        self._random = np.random.default_rng(seed)

    def batch(self, before: np.ndarray, target: np.ndarray) -> None:
        r, c, q, b = self.model.parts[:4]
        n = len(target)
        noise = np.minimum(np.searchsorted(self._cumulative, self._random.random(NOISE)), len(q) - 1)
        predicted = self.model.predict(before)
        wanted, unwanted = q.take(target, 0), q.take(noise, 0)
        good = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", predicted, wanted) + b[target] - self._log[target])))
        pull = (1 - good) / n  # ascent on the log likelihood of data against noise
        push = _push(predicted @ unwanted.T, b[noise] - self._log[noise])
        push /= n
        onto = pull[:, None] * wanted + push @ unwanted
        gq, gb = np.zeros_like(q), np.zeros_like(b)
        rows, seen = _summed(target, np.column_stack([pull[:, None] * predicted, pull]))
        gq[rows], gb[rows] = seen[:, :-1], seen[:, -1]
        np.add.at(gq, noise, push.T @ predicted)
        np.add.at(gb, noise, np.ones(n, np.float32) @ push)
        gc = np.stack([r.take(before[i], 0).T @ onto for i in range(CONTEXT)])
        # Few of the input vectors are in a batch.
        rows, gr = _summed(before.reshape(-1), np.concatenate([onto @ c[i].T for i in range(CONTEXT)]))
        _climb(r, self._squares[0], rows, gr)
        for part, grad, squares in zip((c, q, b), (gc, gq, gb), self._squares[1:]):
            squares += grad * grad
            part += RATE * grad / np.sqrt(squares)

    def own_words(self, before: np.ndarray, own: np.ndarray) -> None:
        """Teach own words against noise from their group, given the vectors predicted from their contexts."""
        wq, wb = self.model.parts[4:]
        sums, vectors = self._own_cumulative, self.model.predict(before)
        for g, rows in _by_group(own, self._starts):
            a, b = self._starts[g], self._starts[g + 1]
            noise = np.searchsorted(sums, sums[a] + self._random.random(GROUP_NOISE) * (sums[b] - sums[a]), "right") - 1
            noise = np.clip(noise, a, b - 1)
            target, predicted = own[rows], vectors.take(rows, 0)
            total = np.float32(np.log(sums[b] - sums[a]))  # biases are logs of counts
            good = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", predicted, wq.take(target, 0)) + wb[target] - total - self._own_log[target])))
            push = _push(predicted @ wq.take(noise, 0).T, wb[noise] - total - self._own_log[noise])
            whole = np.concatenate([predicted, np.ones((len(rows), 1), np.float32)], axis=1)
            values = np.concatenate([(1 - good)[:, None] * whole, push.T @ whole])
            at, grad = _summed(np.append(target, noise), values)
            for part, step, squares in zip((wq, wb), (grad[:, :-1], grad[:, -1]), self._own_squares):
                _climb(part, squares, at, step)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and their hashes, by which a row is known wherever it is computed."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.withColumns({"kid": F.xxhash64("id"), "th": F.xxhash64(F.coalesce("text", F.lit("")))})


def held_out(doc_id, folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def count_tokens(training: DataFrame) -> DataFrame:
    """hash, ending, n of every distinct token of all texts: combined by block, by task, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words, endings, _ = _tokens(block.lower())
                distinct, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(endings[first].astype(np.int32)), pa.array(n)], ["hash", "ending", "n"])

    counted = training.select("text").mapInArrow(count, "hash BIGINT, ending INT, n BIGINT")
    return counted.groupBy("hash", "ending").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head, the groups of own words and the sums per ending class; counts of other words stay in Spark.

    The head has every word of at least the smallest count that at most ``head`` words reach, and every
    own word. Own words are those of at least max(LEAST, ROOT * sqrt(tokens)) occurrences beyond the first
    WORDS, so their number grows with the corpus up to MOST_OWN; ordered by ending they are cut into groups of about
    the square root of their number.
    """
    scale = F.floor(F.log2("n") * 16).cast("int")  # steps of 4.4 %, so a table of a few hundred rows
    steps = counts.groupBy(scale.alias("step")).agg(F.count("*").alias("words")).toPandas().sort_values("step", ascending=False)
    fitting = steps["step"][steps["words"].cumsum() <= head]
    least = int(fitting.min()) if len(fitting) else 1 << 30
    total = counts.agg(F.sum("n")).first()[0] or 0
    enough = max(LEAST, ROOT * total**0.5)
    reached = steps["words"].cumsum() <= MOST_OWN
    if not reached.all():
        enough = max(enough, 2 ** ((steps["step"][reached].min() if reached.any() else 1 << 10) / 16))
    top = counts.where((scale >= least) | (F.col("n") >= enough)).toPandas().sort_values(["n", "hash"], ascending=[False, True])
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens, words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for row in sums:
        tokens[row["ending"]], words[row["ending"]] = row["n"], row["words"]
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    classes = np.full(len(top), -1, np.int32)
    classes[: min(WORDS, len(top))] = np.arange(min(WORDS, len(top)))
    places = np.arange(len(top))
    n, ending = top["n"].to_numpy(np.int64), top["ending"].to_numpy(np.int64)
    grouped = np.flatnonzero((places >= WORDS) & (n >= enough))
    grouped = grouped[np.argsort(ending[grouped], kind="stable")]
    groups = int(np.ceil(len(grouped) ** 0.5))
    starts = (np.arange(groups + 1) * len(grouped) // max(groups, 1)).astype(np.int64)
    own = np.full(len(top), -1, np.int32)
    own[grouped] = np.arange(len(grouped))
    classes[grouped] = CLASSES + np.repeat(np.arange(groups), np.diff(starts))
    class_tokens = np.zeros(CLASSES + groups, np.int64)
    held = np.flatnonzero(classes >= 0)
    np.add.at(class_tokens, classes[held], n[held])
    distinct = int(words.sum())
    np.subtract.at(tokens, ending[held], n[held])
    np.subtract.at(words, ending[held], 1)
    class_tokens[WORDS:CLASSES] = tokens
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order], classes[order], int(total), distinct, tokens, words, class_tokens, own[order], n[grouped], starts)


def _end_input(vocab: Vocabulary) -> int:
    one = np.array([_END])
    at, known = vocab.find(one)
    return int(vocab.inputs(vocab.classes_of(one, np.zeros(1, np.int64), at, known), vocab.own_of(at, known))[0])


def _chunks(model: Model, n: int, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, rows and weights of all parameters: those of an own word are weighted by its occurrences, all others by tokens."""
    r, c, q, b, wq, wb = model.parts
    yield 0, np.concatenate([x.reshape(-1) for x in (r[: model.classes], c, q, b)])[None, :], np.full(1, n, np.float32)
    rows = np.column_stack([r[model.classes :], wq, wb])
    for k, i in enumerate(range(0, model.words, CHUNK)):
        yield k + 1, rows[i : i + CHUNK], (seen[i : i + CHUNK] + 1e-3).astype(np.float32)


def _joined(chunks: list[np.ndarray], classes: int, words: int) -> np.ndarray:
    """The flat parameters from the rows of all chunks in order."""
    shared = chunks[0].reshape(-1)
    rows = np.concatenate([np.zeros((0, 2 * DIMENSION + 1)), *(x.reshape(-1, 2 * DIMENSION + 1) for x in chunks[1:])])
    at = classes * DIMENSION
    return np.concatenate([shared[:at], rows[:, :DIMENSION].reshape(-1), shared[at:], rows[:, DIMENSION:-1].reshape(-1), rows[:, -1]])


_COPIES = "part INT, chunk BIGINT, value BINARY, weight BINARY"


def _averaged(copies: DataFrame, parts: int) -> DataFrame:
    """Means of the chunks of all copies, FAN_IN at a time, so that no task takes more however many copies there are."""

    def add(key: tuple, some: pa.Table) -> pa.Table:
        total = weight = 0.0
        for value, own in zip(some.column("value"), some.column("weight")):
            own = np.frombuffer(own.as_py(), np.float32).astype(np.float64)
            total = total + np.frombuffer(value.as_py(), np.float32).reshape(len(own), -1) * own[:, None]
            weight = weight + own
        sums = [(total / weight[:, None]).astype(np.float32), weight.astype(np.float32)]
        columns = [pa.array([k.as_py()], t) for k, t in zip(key, (pa.int32(), pa.int64()))]
        return pa.table([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["part", "chunk", "value", "weight"])

    while True:
        parts = -(-parts // FAN_IN)
        fewer = F.floor(F.col("part") / FAN_IN).cast("int").alias("part")
        copies = copies.select(fewer, "chunk", "value", "weight").groupBy("part", "chunk").applyInArrow(add, _COPIES)
        if parts <= 1:
            return copies


def train(training: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` passes over all texts.

    The texts are dealt by their hashes to as many copies of the model as there are COPY_TOKENS tokens, and
    sorted, so what is learnt depends on the texts alone and not on how they are stored. In each round every
    copy is trained on its own documents, and Spark averages the
    copies by their numbers of tokens, own words by their numbers of occurrences; only the
    average reaches the driver, which holds 132 bytes for each own word.
    """
    spark = training.sparkSession
    copies = max(1, -(-vocab.tokens // COPY_TOKENS))
    dealt = training.select("text", "th", "kid").repartition(copies, "th", "kid").sortWithinPartitions("th", "kid")
    # Below the number of copies, even if Spark deals the texts to more partitions.
    dealt = dealt.select("text", F.pmod(F.spark_partition_id(), F.lit(copies)).cast("int").alias("part"))
    flat = Model.start(vocab.class_tokens, vocab.own_counts).flat()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, flat))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, flat = shared.value
            part, trainer, end, n = 0, Trainer(Model(flat, *vocab.shape), vocab.class_tokens, 11, vocab.own_counts, vocab.starts), _end_input(vocab), 0
            seen = np.zeros(len(vocab.own_counts), np.int64)
            for batch in batches:
                part = batch.column("part")[0].as_py() if batch.num_rows else part
                for block in blocks(batch.column("text")):
                    words, endings, doc = _tokens(block.lower())
                    at, known = vocab.find(words)
                    classes, own = vocab.classes_of(words, endings, at, known), vocab.own_of(at, known)
                    before = _context(vocab.inputs(classes, own), doc, end)
                    for i in range(0, len(classes), BATCH):
                        trainer.batch(before[:, i : i + BATCH], classes[i : i + BATCH])
                    held = np.flatnonzero(own >= 0)
                    lesson = LESSON * len(vocab.starts)
                    for i in range(0, len(held), lesson):
                        trainer.own_words(before[:, held[i : i + lesson]], own[held[i : i + lesson]])
                    seen += np.bincount(own[held], minlength=len(seen))
                    n += len(classes)
            for chunk, value, weight in _chunks(trainer.model, n, seen) if n else ():
                columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (value, weight))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "value", "weight"])

        mean = _averaged(dealt.mapInArrow(fit, _COPIES), copies).toPandas().sort_values("chunk")
        if len(mean):
            flat = _joined([np.frombuffer(x, np.float32) for x in mean["value"]], *vocab.shape)
    return flat.astype(np.float32)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Score every whole text by the model learnt from the rows outside the held-out fold.

    A null or empty text is its end token alone. Rows are known by hashes of id and text; those that share
    both share their score and all stay; without training rows every token is unknown and the
    model is uniform. Words are compared by 64-bit hashes. An own word has its
    group's probability times its probability within the group. A word without vectors
    has its ending's probability times (count + 1) / (tokens + words + 1) of
    that ending, so the probabilities of all words and of one unknown word add up to 1.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    training = texts.where(~held_out(F.col("id"), folds, fold))
    counts = stage(count_tokens(training), "token-counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast((vocab, train(training, vocab)))
    kind = texts.schema["id"].dataType.simpleString()

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        model, end = Model(flat, *vocab.shape).settle(), _end_input(vocab)
        frequent = _normalisers(model, vocab, flat)
        spread = np.log10(vocab.ending_tokens + vocab.ending_words + 1.0)
        log_counts = np.log10(vocab.counts + 1.0)
        for batch in batches:
            for block in blocks(batch.column("text"), _SCORED_BYTES):
                words, endings, doc = _tokens(block.lower())
                at, known = vocab.find(words)
                classes = vocab.classes_of(words, endings, at, known)
                own_word = vocab.own_of(at, known)
                before = _context(vocab.inputs(classes, own_word), doc, end)
                predicted = model.predict(before)
                found = model.log_probabilities(before, classes, frequent, predicted)
                held = np.flatnonzero(own_word >= 0)
                found[held] += model.own_log_probabilities(before[:, held], own_word[held], vocab.starts, predicted.take(held, 0))
                found /= _LOG10
                shared_class = (classes >= WORDS) & (classes < CLASSES)
                found[shared_class] -= spread[classes[shared_class] - WORDS]
                logs = np.zeros(len(words))
                if len(log_counts):
                    logs[known] = log_counts[at[known]]
                found[shared_class] += logs[shared_class]
                per_doc = lambda x: np.bincount(doc, x, len(block))
                tail = np.flatnonzero(~known)
                order, new = groups(doc[tail], words[tail])
                starts = np.flatnonzero(new)
                rare = tail[order[starts]]
                n = np.diff(np.append(starts, len(order)))
                # First a row for each document, under a hash that counts nothing; then its words beyond the head.
                size, part = len(block), batch.slice(block.rows.start, len(block))
                owner = pa.array(np.append(np.arange(size), doc[rare]))
                whole = lambda x: np.append(x, np.zeros(len(rare), x.dtype))
                own_hash = mix(part.column("th").to_numpy().view(np.uint64))
                columns = [
                    pa.array(np.append(own_hash, words[rare]).view(np.int64)),
                    part.column("kid").take(owner),
                    part.column("th").take(owner),
                    pa.concat_arrays([part.column("id"), pa.nulls(len(rare), part.column("id").type)]),
                    pa.array(whole(np.ones(size, np.int32))),
                    pa.array(np.append(np.zeros(size, np.int64), n).astype(np.int32)),
                    *(pa.array(whole(per_doc(x).astype(t))) for x, t in ((None, np.int64), (known, np.int64), (logs, np.float64), (found, np.float64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "kid", "th", "id", "rows", "n", "n_tokens", "n_known", "logs", "score"])

    schema = f"hash BIGINT, kid BIGINT, th BIGINT, id {kind}, rows INT, n INT, n_tokens BIGINT, n_known BIGINT, logs DOUBLE, score DOUBLE"
    scored = texts.select("kid", "th", "id", "text").mapInArrow(score_texts, schema)
    joined = scored.join(counts.select("hash", F.col("n").alias("c")), "hash", "left")
    base, times = F.col("rows") > 0, F.sum("rows")
    tail = F.sum(F.when(~base, F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).otherwise(0.0)) / times
    one = lambda c: F.max(F.when(base, F.col(c)))
    sums = joined.groupBy("kid", "th").agg(
        F.max("id").alias(id_col),
        times.alias("rows"),
        one("n_tokens").alias("n_tokens"),
        (one("n_known") + F.expr("sum(CASE WHEN rows = 0 AND c IS NOT NULL THEN n ELSE 0 END) DIV sum(rows)")).alias("n_known"),
        (one("logs") + tail).alias("logs"),
        (one("score") + tail).alias("score"),
    )
    per_token = float(np.log10(vocab.tokens + vocab.distinct + 1.0))
    return sums.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).select(
        id_col,
        held_out(F.col(id_col), folds, fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
