import hashlib

import pytest
from pyspark.sql import functions as F

import naive
from lexispectra.operators.ranking import with_global_rank
from lexispectra.operators.vocabulary import build_vocab


def ranked(vocab):
    return [(r["id"], r["word"], r["count"]) for r in vocab.orderBy("id").collect()]


def test_order_of_equal_counts_is_by_bytes(lines):
    found = ranked(build_vocab(lines(["é b aé ab a"]), min_count=1))
    assert found == [(1, "a", 1), (2, "ab", 1), (3, "aé", 1), (4, "b", 1), (5, "é", 1)]


def test_ties_at_the_size_limit(lines):
    corpus = lines(["a a a b c d"])
    tied = min("bcd", key=lambda w: hashlib.md5(w.encode()).hexdigest())
    assert ranked(build_vocab(corpus, min_count=1, max_vocab=2)) == [(1, "a", 3), (2, tied, 1)]
    assert ranked(build_vocab(corpus, min_count=2, max_vocab=2)) == [(1, "a", 3)]


def test_size_limit_above_the_vocabulary(lines):
    assert len(ranked(build_vocab(lines(["a b"]), min_count=0, max_vocab=9))) == 2


def test_reserved_word(lines):
    with pytest.raises(Exception, match="reserved word"):
        build_vocab(lines(["a <unk> b"] * 3), min_count=10)


def test_words_that_look_like_missing_values(lines):
    found = ranked(build_vocab(lines(["nan null NA nan"]), min_count=1))
    assert found == [(1, "nan", 2), (2, "NA", 1), (3, "null", 1)]


def test_against_plain_python(lines):
    texts = naive.corpus(1)
    expected = naive.vocabulary(texts, 3)
    assert {w: i for i, w, _ in ranked(build_vocab(lines(texts), min_count=3))} == expected


def test_empty_corpus(lines):
    assert ranked(build_vocab(lines([""]), min_count=1)) == []


def test_global_rank_over_many_partitions(spark):
    numbers = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    found = with_global_rank(numbers, [F.desc("x")], "place")
    assert found.where("place <> 5000 - x").count() == 0
    assert found.count() == 5000


def test_negative_limits(lines):
    with pytest.raises(ValueError):
        build_vocab(lines(["a"]), min_count=-1)
