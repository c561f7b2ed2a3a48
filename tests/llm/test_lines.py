"""Line dedup next to plain Python, and its index under insertions and deletions."""

import hashlib
import random
import re

import naive_llm as naive
import numpy as np
import pytest

from lexispectra.llm import lines
from lexispectra.llm.cuckoo import SLOTS, Cuckoo

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return line.strip(SPACE).translate(naive.LOWER)


def brute(texts, least=10):
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for own in split:
        for k in {key(x) for x in own} - {""}:
            count[k] = count.get(k, 0) + 1
    kept = [[x for x in own if count.get(key(x), 0) < least] for own in split]
    return [(len(own), len(own) - len(k), "\n".join(k)) for own, k in zip(split, kept)]


def corpus(rng, n):
    common = ["Subscribe now", "ÉTÉ 2024", "a", "#", "all rights  reserved"]
    texts = [None, "", "\n", " \t\n\x0b", "\r\n", "x" * 50_000 + "\n" + "Subscribe now\n" * 300]
    for _ in range(n):
        own = [rng.choice(common) for _ in range(rng.randrange(3))] + ["".join(rng.choices("abAB é", k=rng.randrange(6))) for _ in range(rng.randrange(6))]
        rng.shuffle(own)
        texts.append("\n".join(rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " \x0c"]) for x in own))
    return texts


def check(found, texts, least=10):
    for i, (n, dropped, kept) in enumerate(brute(texts, least)):
        (row,) = found[i]
        assert (row._n_lines, row._n_dropped, row.text) == (n, dropped, texts[i] if not dropped else kept), i


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, rows, monkeypatch, small):
    if small:  # many shards, filters in several passes, no broadcast of the exact lines
        monkeypatch.setattr(lines, "SHARD_KEYS", 4)
        monkeypatch.setattr(lines, "FILTER_BYTES", 40)
        monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    texts = corpus(random.Random(5), 150)
    found = lines.without_common_lines(docs(texts))
    assert found.columns == [*docs(texts).columns, "_n_lines", "_n_dropped"]
    check(rows(found), texts)


def test_digests(docs, rows):
    texts = corpus(random.Random(6), 60)
    found = rows(lines.digests(docs(texts).repartition(5)))
    for i, (n, dropped, kept) in enumerate(brute(texts)):
        assert tuple(found[i][0]) == (i, n, dropped, hashlib.sha256(kept.encode()).hexdigest())


def test_repeated_rows_null_ids_and_empty_tables(docs, rows):
    texts = ["same line\nown"] * 6 + ["same line"] * 4 + ["same line\nother"]
    found = rows(lines.digests(docs(texts, [1, 1, 1, 2, 2, None, None, 3, 4, 5, 5])))
    assert all(r.n_dropped == 1 for own in found.values() for r in own) and sum(map(len, found.values())) == 11
    assert lines.digests(docs([])).count() == 0
    assert lines.LineIndex.build(docs([])).drop(docs(texts)).where("_n_dropped > 0").count() == 0


@pytest.mark.parametrize("shard_keys", [500_000, 3])
def test_index_is_reversible(docs, rows, monkeypatch, shard_keys):
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    texts = corpus(random.Random(7), 240)
    first, second = docs(texts[:120]), docs(texts[120:], range(120, len(texts)))
    state = lambda index: sorted(map(tuple, index.refs.collect()))
    one = lines.LineIndex.build(first, min_docs=4)
    both = one.insert(second)
    assert state(both) == state(lines.LineIndex.build(first.unionByName(second), min_docs=4))
    check(rows(both.drop(first.unionByName(second))), texts, 4)
    back = both.delete(second)
    assert state(back) == state(one)
    check(rows(back.drop(first)), texts[:120], 4)
    check(rows(one.drop(first)), texts[:120], 4)  # the old index still stands
    assert state(back.delete(first)) == []
    with pytest.raises(ValueError):
        one.delete(second)
    both.discard()


def keys(rng, n):
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000, 60_000):
        h1, h2 = keys(rng, n)
        filter = Cuckoo.of(h1, h2)
        assert filter.contains(h1, h2).all() and (filter.table > 0).sum() == n
        assert filter.contains(*keys(rng, 100_000)).mean() < 1e-3
        filter.delete(h1[: n // 2], h2[: n // 2])
        assert filter.contains(h1[n // 2 :], h2[n // 2 :]).all() and (filter.table > 0).sum() == n - n // 2
        assert Cuckoo.from_bytes(filter.to_bytes()).contains(h1[n // 2 :], h2[n // 2 :]).all()


def test_cuckoo_filter_that_is_full_stays_as_it_was():
    h1, h2 = keys(np.random.default_rng(4), 400)
    filter = Cuckoo(np.zeros((64, SLOTS), np.uint16))
    assert filter.insert(h1[:150], h2[:150])
    before = filter.to_bytes()
    assert not filter.insert(h1[150:], h2[150:]) and filter.to_bytes() == before
    with pytest.raises(KeyError):
        Cuckoo.empty(10).delete(h1[:1], h2[:1])


def test_cuckoo_filter_counts_equal_marks():
    """Keys that share both buckets and the mark take a slot each, and lose one each."""
    h1, h2 = np.full(5, 3, np.uint64), np.arange(5, dtype=np.uint64) * np.uint64(65_535)
    filter = Cuckoo.empty(100)
    assert filter.insert(h1, h2)
    filter.delete(h1[:3], h2[:3])
    assert (filter.table > 0).sum() == 2 and filter.contains(h1[3:], h2[3:]).all()


def test_lines_tile_a_block():
    from lexispectra.llm.text import blocks
    import pyarrow as pa

    texts = ["", "a\n", "\n\n", "b", "", " x \n y\n"]
    (block,) = blocks(pa.array(texts))
    found = lines.Lines.of(block)
    data = block.data.tobytes()
    cut = [[] for _ in texts]
    for d, a, b in zip(found.doc, found.starts, found.ends):
        cut[d].append(data[a:b].decode())
    assert cut == [t.split("\n") for t in texts]
    assert [bool(re.search("[^ ]", x)) for own in cut for x in own] == found.filled.tolist()
