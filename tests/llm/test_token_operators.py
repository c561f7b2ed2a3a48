"""Token files and packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexispectra.llm import packing, tokenfile
from lexispectra.llm.encoder import tokenizer_path

random.seed(8)
TEXTS = [None, "", "Plain words.", "é" * 5000, "x<|endoftext|>y", " \n ", "word " * 9000, "a b c", "a b c"]


def library_ids(name, text, end):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes_round_trip(planes):
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), np.random.default_rng(1).integers(0, 1 << 32, 1001).astype(np.uint32)):
        parts = dict(enumerate(tokenfile.split_planes(ids, planes)))
        assert (tokenfile.join_planes(parts, len(ids), planes) == ids).all()
        some = {k: p for k, p in parts.items() if any(p)}
        assert (tokenfile.join_planes(some, len(ids), planes) == ids).all()


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_file_round_trip_over_many_blocks(planes):
    random_ids = np.random.default_rng(2)
    docs = [random_ids.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 99, 100, 101, 1000, 3)]
    out = pa.BufferOutputStream()
    writer = tokenfile.Writer(out, planes, block=100)
    for i in range(0, len(docs), 3):
        some = docs[i : i + 3]
        writer.add([f"é{k}" for k in range(i, i + len(some))], np.concatenate(some), np.cumsum([0, *map(len, some)]))
    assert writer.close() == (7, 1304)
    reader = tokenfile.Reader(pa.BufferReader(out.getvalue()))
    assert reader.keys == [f"é{k}" for k in range(7)] and reader.lengths.tolist() == [len(d) for d in docs]
    assert (np.concatenate(list(reader.blocks())) == np.concatenate(docs)).all()
    assert list(reader.checksums()) == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
    with pytest.raises(ValueError):
        tokenfile.Reader(pa.BufferReader(b"x" * 100))


def test_token_files(docs):
    ids = [4, 9, 2, None, 7, 1, 3, 8, 8]
    found = sorted(tokenfile.tokens_round_trip(docs(TEXTS, ids)).collect(), key=lambda r: r.start)
    expected, start = [], 0
    for i, text in sorted(zip(ids, TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        tokens = library_ids("word_bpe_49k.json", text, 2)
        expected.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert [tuple(r) for r in found] == expected
    assert tokenfile.tokens_round_trip(docs([])).count() == 0


def check_places(rows, capacity):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= capacity
    return len(ends)


def test_packing(docs, rows):
    ids = [4, 9, 2, None, 7, 1, 3, 8, 8]
    packed = packing.pack_documents(docs(TEXTS, ids), capacity=64)
    found = rows(packed)
    check_places(packed.collect(), 64)
    for i, text in zip(ids, TEXTS):
        tokens = library_ids("byte_bpe_50k.json", text, 0)
        n = len(tokens)
        cuts = [0, *range(n % 64 or 64, n + 1, 64)] if n > 64 else [0, n]
        expected = [(k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found[i])
        assert got == sorted(expected * ids.count(i)) if i != 8 else got == sorted(expected * 2)
    assert packing.pack_documents(docs([])).count() == 0


def test_exchange_closes_gaps(spark):
    sizes = [random.randint(1, 120) for _ in range(900)]
    given = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")
    apart = packing.pack(given, 128, group=30, rounds=0)
    joined = packing.pack(given, 128, group=30, rounds=3)
    counts = [check_places(x.collect(), 128) for x in (apart, joined)]
    assert sorted(r.id for r in joined.collect()) == list(range(900))
    assert counts[1] < counts[0]


def test_bounds_never_exceed_the_best_packing():
    for trial in range(300):
        sizes = np.random.default_rng(trial).integers(1, 13, 7)
        best = min(_bins(sizes.tolist(), 12))
        bound = packing.lower_bound(sizes, 12)
        assert -(-sizes.sum() // 12) <= bound <= best
        assert len(packing.best_fit(sizes, 12)[2]) >= best
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3


def _bins(sizes, capacity, bins=()):
    """Numbers of bins of all packings."""
    if not sizes:
        yield len(bins)
        return
    for k, b in enumerate(bins):
        if b + sizes[0] <= capacity:
            yield from _bins(sizes[1:], capacity, (*bins[:k], b + sizes[0], *bins[k + 1 :]))
    yield from _bins(sizes[1:], capacity, (*bins, sizes[0]))
