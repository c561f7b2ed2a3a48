import pytest
from pyspark.sql import functions as F

from lexispectra.functions.encoding import decode_text
from lexispectra.functions.text import truncate_word
from lexispectra.sources.corpus import corpus_lines, read_corpus, tokens, words


def test_tokeniser_on_a_text_file(spark, tmp_path):
    (tmp_path / "corpus.txt").write_bytes(b"a\rb  \tc\r\n\n d\x0be \n")
    lines = read_corpus(spark, str(tmp_path / "corpus.txt")).withColumn("n", F.monotonically_increasing_id())
    assert lines.count() == 3
    # Lines may be spread over the cores in any order; words keep their order within a line.
    by_line = {}
    for r in tokens(lines).orderBy("pos").collect():
        by_line.setdefault(r["n"], []).append(r["word"])
    assert sorted(by_line.values()) == [["ab", "c"], ["d\x0be"]]


def test_last_line_without_newline(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("a b")
    assert sorted(r["word"] for r in words(read_corpus(spark, str(tmp_path / "corpus.txt"))).collect()) == ["a", "b"]


def test_only_space_and_tab_separate(lines):
    found = words(lines(["a b\x0cc d\te f"])).collect()
    assert [r["word"] for r in found] == ["a b\x0cc", "d", "e f"]


def test_corpus_table_keeps_other_columns(spark):
    docs = spark.createDataFrame([(7, "x\n\ny"), (8, None)], "doc_id INT, text STRING")
    found = corpus_lines(docs).orderBy("line_no").collect()
    assert [(r["doc_id"], r["line_no"], r["line"]) for r in found] == [(7, 0, "x"), (7, 1, ""), (7, 2, "y")]


def test_other_encoding(spark, tmp_path):
    (tmp_path / "corpus.txt").write_bytes("naïve €5".encode("cp1252"))
    found = words(read_corpus(spark, str(tmp_path / "corpus.txt"), "cp1252")).collect()
    assert [r["word"] for r in found] == ["naïve", "€5"]


def test_long_words(spark):
    cases = {
        "a" * 998: 998,
        "b" * 999: 999,
        "c" * 1000: 999,
        "d" * 998 + "é": 998,
        "e" * 997 + "€": 997,
        "f" * 997 + "é": 999,
        "g" * 996 + "😀": 996,
        "h" * 997 + "😀x": 997,
        "i" * 998 + "😀x": 998,
        "j" * 996 + "�" + "x": 999,
        "k" * 993 + "��" + "é": 999,
        "é" * 700: 998,
    }
    rows = spark.createDataFrame([(w, n) for w, n in cases.items()], "word STRING, expected INT")
    for row in rows.select("word", "expected", truncate_word(F.col("word")).alias("kept")).collect():
        assert len(row["kept"].encode()) == row["expected"]
        assert row["word"].startswith(row["kept"])


def test_encodings_of_more_than_one_byte_are_refused():
    for encoding in ("gbk", "utf-16", "shift_jis", "utf-7", "iso2022_jp"):
        with pytest.raises(ValueError, match="single-byte"):
            decode_text(F.lit("x"), encoding)
