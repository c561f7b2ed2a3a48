import io
import random

import pytest
from pyspark.sql import functions as F

import naive
from lexispectra.operators.cooccurrence import count_cooccurrence
from lexispectra.operators.vocabulary import word_count
from lexispectra.plans.pipeline import cooccurrence_files, vocabulary_files
from lexispectra.sources import pieces as P
from lexispectra.sources.cooccurrence import read_cooccurrence_bin


def corpus(seed, long_lines=3):
    rng = random.Random(seed)
    texts = naive.corpus(seed, lines=20)
    for i in range(long_lines):
        parts = naive.corpus(seed + 10 + i, lines=rng.randrange(5, 30))
        # Stretches of unknown words fill whole ranges.
        parts.insert(len(parts) // 2, " ".join(f"x{rng.random()}" for _ in range(60)))
        texts.insert(rng.randrange(len(texts)), " ".join(parts))
    return texts


def cells(table):
    rows = table.collect()
    found = {(r["row"], r["col"]): r["val"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("split, line, end", [(700, 50, ""), (1500, 300, "\n"), (1 << 20, 100, "")])
def test_words_and_counts_of_cut_lines(spark, tmp_path, vocab, split, line, end):
    texts = corpus(split)
    (tmp_path / "a.txt").write_text("\n".join(texts) + end)
    (tmp_path / "b.txt").write_text("w1 w2\r\n\n\nw3")
    (tmp_path / "c.txt").write_text("")
    texts = [*texts, "w1 w2\r", "", "", "w3"]
    pieces = P.read_corpus_pieces(spark, str(tmp_path), split_bytes=split, line_bytes=line)
    counts = {r["word"]: r["count"] for r in word_count(pieces).collect()}
    expected = {}
    for text in texts:
        for word in naive.words(text):
            expected[word] = expected.get(word, 0) + 1
    assert counts == expected
    ids = naive.vocabulary(texts, 5)
    words = vocab(ids)
    for code, window, symmetric, limit in ((1, 10, True, 1 << 28), (4, 3, False, 1 << 28), (2, 7, True, 0)):
        found = cells(count_cooccurrence(pieces, words, window, code, symmetric, broadcast_bytes=limit))
        wanted = naive.cooccurrence(texts, ids, window, code, symmetric)
        assert found.keys() == wanted.keys()
        assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_lines_up_to_the_limit_are_whole(spark, tmp_path):
    texts = naive.corpus(5)
    (tmp_path / "a.txt").write_bytes(("\n".join(texts) + "\n").encode())
    found = P.read_corpus_pieces(spark, str(tmp_path / "a.txt"), split_bytes=1000, line_bytes=100_000)
    assert [r["line"] for r in found.orderBy("line_id").collect()] == texts
    assert found.where("cut").count() == 0


def test_overlong_words(spark, tmp_path):
    words = ["a" * 5000, "é" * 3000, "b" * 998 + "é" * 900, "\r" * 4000 + "c" * 1200, "d"]
    (tmp_path / "a.txt").write_bytes(" ".join(words).encode() + b"\n" + ("e" * 4000).encode())
    found = P.read_corpus_pieces(spark, str(tmp_path / "a.txt"), split_bytes=1900, line_bytes=150)
    counts = {r["word"]: r["count"] for r in word_count(found).collect()}
    assert counts == {"a" * 999: 1, "é" * 499: 1, "b" * 998: 1, "c" * 999: 1, "d": 1, "e" * 999: 1}


@pytest.mark.parametrize("seed", range(5))
def test_ranges_cover_every_byte_once(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab \t\n" if seed % 2 else b"aaaaaaab \n") for _ in range(400))
    for split, line in ((7, 3), (20, 10), (33, 100), (1, 1)):
        cuts = [P.find_cut(io.BytesIO(data), at, len(data), line) for at in [*range(0, len(data), split), len(data)]]
        assert [c for c, _ in cuts] == sorted(c for c, _ in cuts) and (cuts[0][0], cuts[-1][0]) == (0, len(data))
        for cut, clean in cuts[1:-1]:
            assert cut == len(data) or data[cut - 1 : cut] in ((b"\n",) if clean else (b" ", b"\t"))


def test_file_entry_points_and_compressed_files(spark, tmp_path):
    import gzip

    texts = naive.corpus(3)
    data = "\n".join(texts).encode()
    (tmp_path / "plain.txt").write_bytes(data)
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(data))
    ids = naive.vocabulary(texts, 2)
    wanted = naive.cooccurrence(texts, ids, 4, 1, True)
    for name in ("plain.txt", "packed.txt.gz"):
        out = [str(tmp_path / f"{name}-{part}") for part in ("vocab", "cooc")]
        vocabulary_files(spark, str(tmp_path / name), out[0], min_count=2)
        cooccurrence_files(spark, str(tmp_path / name), *out, window=4)
        found = cells(read_cooccurrence_bin(spark, out[1]))
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)
    with pytest.raises(ValueError, match="compressed"):
        P.read_corpus_pieces(spark, str(tmp_path / "packed.txt.gz"))


def test_empty_corpus(spark, tmp_path, vocab):
    (tmp_path / "a.txt").write_text("")
    found = P.read_corpus_pieces(spark, str(tmp_path / "a.txt"))
    assert found.count() == 0
    assert cells(count_cooccurrence(found, vocab(["a"]))) == {}
    with pytest.raises(ValueError, match="positive"):
        P.read_corpus_pieces(spark, str(tmp_path / "a.txt"), split_bytes=0)


def test_short_ranges_share_tasks(spark, tmp_path, vocab):
    texts = [f"a b c{i % 7} " * 30 for i in range(60)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n")
    lines = P.read_corpus_pieces(spark, str(tmp_path / "a.txt"), split_bytes=40, line_bytes=10)
    ranges = lines.select(F.shiftright("line_id", 32)).distinct().count()
    assert ranges > 200 and lines.rdd.getNumPartitions() <= 2 * P._TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    known = vocab(["a", "b", *(f"c{i}" for i in range(7))])
    whole = spark.createDataFrame([(t,) for t in texts], "line STRING")
    found = {(r["row"], r["col"]): r["val"] for r in count_cooccurrence(lines, known, 10).collect()}
    assert found == pytest.approx({(r["row"], r["col"]): r["val"] for r in count_cooccurrence(whole, known, 10).collect()})
