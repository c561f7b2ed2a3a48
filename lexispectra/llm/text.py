"""Words and hashes of whole Arrow batches of texts, without a Python loop over words.

A batch is cut into blocks of about ``BLOCK_BYTES`` at document ends, so memory
is bounded by that figure or by the longest single document. Hashes are
polynomials modulo 2**64 over per-byte random numbers, taken from prefix sums
and mixed; equal input gives equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SEED = 20_240_917
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Words are runs of bytes other than these: the contract's [^\x20\x09-\x0D]+.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; ``values`` are 64-bit numbers."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(values) + 1)[starts])


@dataclass
class Block:
    """Some documents: their bytes and where each begins and ends."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Block:
        """ASCII capitals in lower case, all else unchanged."""
        return Block(self.rows, LOWER[self.data], self.offsets)

    def per_doc(self, marked: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for every document."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def in_word(self) -> np.ndarray:
        return IN_WORD[self.data]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of every word."""
        inside = self.in_word
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[:-1][self.offsets[:-1] < len(inside)]] = False
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """Number of the first word of every document, and of the end."""
        return np.searchsorted(self.bounds[0], self.offsets)

    @cached_property
    def doc(self) -> np.ndarray:
        """Document of every word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    @cached_property
    def words(self) -> np.ndarray:
        """Hash of every word."""
        return span_hashes(_BYTE[self.data], *self.bounds)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of every span."""
        return span_hashes(_BYTE[self.data], starts, ends)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` words of one document."""
        at = np.arange(len(self.words))
        at = at[at + n <= self.first[1:][self.doc]]
        return at, span_hashes(self.words, at, at + n)

    def word_bytes(self, numbers: np.ndarray) -> list[bytes]:
        starts, ends = self.bounds
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(starts[numbers].tolist(), ends[numbers].tolist())]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Documents of a column in order; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        last = min(last, len(texts))
        yield Block(slice(row, last), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def groups(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (document, hash), and whether each place in that order starts a new pair."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return order, new
