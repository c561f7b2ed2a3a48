"""Cuckoo filter over 128-bit keys, filled, emptied and asked for many keys at a time."""

from __future__ import annotations

import math

import numpy as np

from lexispectra.llm.text import mix

#: Marks of a bucket, share of the slots that a new filter fills, and turns before an insertion counts as failed.
SLOTS, LOAD, TURNS = 4, 0.85, 1000
_MARKS = np.uint64(65_535)


class Cuckoo:
    """A set of keys (h1, h2) as 16-bit marks, two buckets of four slots for each.

    It never misses a key it holds; another key is taken for one of them with a
    probability of 1.2e-4. A key may be deleted only if it was inserted.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def empty(cls, keys: int) -> Cuckoo:
        """Room for so many keys."""
        buckets = 1 << math.ceil(math.log2(max(1.0, keys / (SLOTS * LOAD))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
        """A filter of these keys, as large as it takes."""
        found = cls.empty(len(h1))
        while not found.insert(h1, h2):
            found = cls.empty(2 * found.table.size)
        return found

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return (at.astype(np.uint64) ^ (mix(mark.astype(np.uint64)) & mask)).astype(np.int64)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h2 % _MARKS + np.uint64(1)).astype(np.uint16)
        at = (h1 & np.uint64(len(self.table) - 1)).astype(np.int64)
        return at, self._other(at, mark), mark

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at, other, mark = self._places(h1, h2)
        return ((self.table[at] == mark[:, None]) | (self.table[other] == mark[:, None])).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Add distinct keys; False, with the filter as it was, if they do not fit.

        All keys move together: each takes a free slot of its bucket, else tries its
        other bucket, else one key for each bucket takes the place of a mark there, which moves on.
        """
        table = self.table.copy()
        at, other, mark = self._places(h1, h2)
        if len(at) > table.size:
            return False
        for turn in range(TURNS):
            if not len(at):
                self.table = table
                return True
            order = np.argsort(at, kind="stable")
            at, other, mark = at[order], other[order], mark[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            free = np.cumsum(table[at] == 0, 1)
            fits = rank < free[:, -1]
            slot = (free > rank[:, None]).argmax(1)
            table[at[fits], slot[fits]] = mark[fits]
            at, other, mark = at[~fits], other[~fits], mark[~fits]
            if turn % 2 and len(at):
                _, one = np.unique(at, return_index=True)
                slot = (mark[one].astype(np.int64) + turn // 2) % SLOTS
                moved = table[at[one], slot]
                table[at[one], slot] = mark[one]
                mark[one], other[one] = moved, self._other(at[one], moved)
            at, other = other, at
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove one mark for each key; a KeyError if there is none."""
        at, other, mark = self._places(h1, h2)
        while len(at):
            here, there = self.table[at] == mark[:, None], self.table[other] == mark[:, None]
            if not (here.any(1) | there.any(1)).all():
                raise KeyError("a key was not in the filter")
            place = np.where(here.any(1), at * SLOTS + here.argmax(1), other * SLOTS + there.argmax(1))
            place, one = np.unique(place, return_index=True)
            self.table.reshape(-1)[place] = 0
            left = np.ones(len(at), bool)
            left[one] = False
            at, other, mark = at[left], other[left], mark[left]
