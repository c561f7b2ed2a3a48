"""Quality rules by compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.text import Block, blocks, groups

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size, by the size in UTF-8 bytes.

    ``limits`` are (least size, least ratio, greatest ratio), rising in size; the
    last one whose least size fits holds, and smaller texts have none. Short
    texts compress worse, since the frame and the first occurrences weigh
    more. Texts of ``chunk_bytes`` or more are also cut into chunks of that size,
    the last of which ends where the text ends and so overlaps the one before,
    and fail when chunks outside ``chunk_limits`` hold more than ``chunk_share``
    of the bytes (a byte in two chunks belongs to the first).
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (256, 0.20, 1.00),
        (512, 0.30, 0.90),
        (2048, 0.28, 0.74),
        (16384, 0.24, 0.70),
    )
    chunk_bytes: int = 4096
    chunk_limits: tuple[float, float] = (0.22, 0.78)
    chunk_share: float = 0.2
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


MEASURES = (
    "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
    "ratio DOUBLE, chunks_out DOUBLE, base_failed BOOLEAN, kept BOOLEAN"
)


def _duplicate_lines(block: Block) -> np.ndarray:
    breaks = np.flatnonzero(block.data == 0x0A)
    starts = np.union1d(breaks + 1, block.offsets[:-1])
    starts = starts[starts < len(block.data)]
    ends = np.append(breaks, len(block.data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(ends, block.offsets[np.searchsorted(block.offsets, starts, "right")])
    word_starts = block.bounds[0]
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[filled], ends[filled]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    order, new = groups(doc, block.spans(starts, ends))
    return np.bincount(doc[order], ~new, len(block)).astype(np.int64)


def _repeated_words(block: Block) -> np.ndarray:
    at, hashes = block.windows(3)
    order, new = groups(block.doc[at], hashes)
    alone = new & np.append(new[1:], True)
    covered = np.zeros(len(block.words) + 2, bool)
    found = at[order[~alone]]
    for k in range(3):
        covered[found + k] = True
    return np.bincount(block.doc, covered[:-2], len(block)).astype(np.int64)


def _ratios(block: Block, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    ratio, out = np.zeros(len(block)), np.zeros(len(block))
    low, high = bands.chunk_limits
    for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
        if a == b:
            continue
        text = block.data[a:b]
        ratio[i] = len(squeeze.compress(text)) / (b - a)
        size = bands.chunk_bytes
        if b - a >= size:
            starts = [min(k, b - a - size) for k in range(0, b - a, size)]
            bad = [not low <= len(squeeze.compress(text[k : k + size])) / size <= high for k in starts]
            own = np.diff([*range(0, b - a, size), b - a])
            out[i] = own[bad].sum() / (b - a)
    return ratio, out


def _measure(block: Block, bands: Bands) -> dict[str, np.ndarray]:
    lead = (block.data & 0xC0) != 0x80
    n_words = np.diff(block.first).astype(np.int64)
    repeated = _repeated_words(block)
    failed = (n_words < bands.min_words) | (100 * repeated > bands.max_repeat_percent * n_words)
    ratio, out = _ratios(block, bands)
    least, low, high = (np.array(x) for x in zip((0, 0.0, np.inf), *bands.limits))
    band = np.searchsorted(least, np.diff(block.offsets), "right") - 1
    within = (low[band] <= ratio) & (ratio <= high[band]) & (out <= bands.chunk_share)
    return {
        "n_words": n_words,
        "word_chars": block.per_doc(block.in_word & lead),
        "n_symbols": block.per_doc(_SYMBOL[block.data]),
        "n_dup_lines": _duplicate_lines(block),
        "n_repeat_words": repeated,
        "ratio": ratio,
        "chunks_out": out,
        "base_failed": failed,
        "kept": ~failed & within,
    }


def _measured(texts: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    parts = [_measure(block, bands) for block in blocks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row of measures and verdict per document; rows are judged one by one, so repeated rows stay.

    A null or empty text has no words and fails the base rule. Columns other
    than ``id_col`` and ``text_col`` are not read. Hashes of 64 bits are compared
    only within one document.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _measured(batch.column("text"), bands)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found.values())], ["id", *found])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(measure, f"id {kind}, {MEASURES}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Block by block, so that no second copy of a batch is held.
            for block in blocks(batch.column(text_col)):
                yield batch.slice(block.rows.start, len(block)).filter(pa.array(_measure(block, bands)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
