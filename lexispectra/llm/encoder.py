"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once."""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import accumulate, chain, islice, repeat
from types import ModuleType

import numpy as np

#: Chunks that a worker process remembers before it forgets those it has not met again; bounds its memory.
REMEMBERED = 300_000
# Where the library itself may cut differently from white space: separators that
# only Python counts as white space, and strings of special tokens.
_WHOLE = "\x1c", "\x1d", "\x1e", "\x1f", "<|"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACED = re.compile(rf" ?[{_LETTERS}]+(?=[,.!?;:\s]|\Z)| ?\S+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"[{_LETTERS}]+(?=[,.!?;:\s]|\Z)|\S+")
# Chunks that the library's own rules leave in one piece and do not change.
_SPACED_LETTERS = re.compile(rf" ?[{_LETTERS}]+")
_SMALL_LETTERS = re.compile("[a-zß-öø-ÿ]+")


class Encoder:
    """Encodes texts with one byte-level BPE file and appends ``end`` to each.

    Such a file cuts a text at white space, and a run of letters before punctuation,
    before it looks for merges, so the ids of a text are those of its chunks in
    order. ``spaced`` is for files that keep a space with the word after it; the
    others drop white space and case, and get ASCII capitals in lower case. Chunks
    of letters alone skip the file's normaliser and pattern, which leave
    them as they are. Texts for which any of this need not hold are encoded whole.
    """

    def __init__(self, path: str, end: int, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._key = path, end, spaced
        self._library = Tokenizer.from_file(path)
        self._letters = Tokenizer.from_file(path)
        self._letters.normalizer = None
        self._letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters.model._resize_cache(0)  # we remember chunks ourselves
        self._end, self._spaced = end, spaced
        self._forget()

    def __reduce__(self) -> tuple:
        return Encoder, self._key

    def _forget(self) -> None:
        self._number: dict[str | None, int] = {None: 0}
        self._ids, self._starts = array("I", [self._end]), array("q", [0, 1])
        self._again = np.zeros(0, bool)

    def _tidy(self) -> None:
        """Keeps the chunks that were met again since they were learnt or kept, if these are at most half of what may be remembered."""
        number, ids, starts, again = self._number, self._ids, self._starts, self._again
        self._forget()
        if np.count_nonzero(again) <= REMEMBERED // 2:
            kept = [(c, n) for (c, n), k in zip(islice(number.items(), 1, None), again[1:].tolist()) if k]
            for chunk, n in kept:
                self._number[chunk] = len(self._number)
                self._ids.extend(ids[starts[n] : starts[n + 1]])
                self._starts.append(len(self._ids))

    def _learn(self, chunks: set[str]) -> None:
        simple = (_SPACED_LETTERS if self._spaced else _SMALL_LETTERS).fullmatch
        letters = {c for c in chunks if simple(c)}
        for library, some in ((self._letters, sorted(letters)), (self._library, sorted(chunks - letters))):
            found = [x.ids for x in library.encode_batch_fast(some, add_special_tokens=False)]
            ends = accumulate(map(len, found), initial=len(self._ids))
            next(ends)
            self._number.update(zip(some, range(len(self._number), len(self._number) + len(some))))
            self._starts.extend(ends)
            self._ids.extend(chain.from_iterable(found))

    def _chunks(self, text: str) -> list[str]:
        if any(part in text for part in _WHOLE):
            return [text]
        return _SPACED.findall(text) if self._spaced else _PLAIN.findall(text.encode().lower().decode())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text begins and ends among them; a null is an empty text."""
        if len(self._number) > REMEMBERED:
            self._tidy()
        chunks: list[str | None] = []
        ends = [0]
        for text in texts:
            if text:
                chunks += self._chunks(text)
            chunks.append(None)
            ends.append(len(chunks))
        number = np.fromiter(map(self._number.get, chunks, repeat(-1)), np.int64, len(chunks))
        self._again = np.append(self._again, np.zeros(len(self._number) - len(self._again), bool))
        unknown = np.flatnonzero(number < 0)
        self._again[number[number >= 0]] = True
        new = [chunks[i] for i in unknown.tolist()]
        self._learn(set(new))
        number[unknown] = [self._number[c] for c in new]
        starts = np.frombuffer(self._starts, np.int64)
        lengths = np.diff(starts)[number]
        before = np.zeros(len(number) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        places = np.repeat(starts[number] - before[:-1], lengths) + np.arange(before[-1])
        ids = np.frombuffer(self._ids, np.uint32)[places]
        del starts  # else the arrays could not grow
        return ids, before[ends]


def encoder(path: str, end: int, spaced: bool) -> Encoder:
    """One encoder for each worker process, which keeps what it has learnt.

    Task functions travel by value, so a variable of this module would live for
    one task only; the interpreter's table of modules outlives it.
    """
    kept = sys.modules.setdefault("_lexispectra_encoders", ModuleType("_lexispectra_encoders"))
    if not hasattr(kept, "encoders"):
        kept.encoders = {}
    key = path, end, spaced
    if key not in kept.encoders:
        kept.encoders[key] = Encoder(*key)
    return kept.encoders[key]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
