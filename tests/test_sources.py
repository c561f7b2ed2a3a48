import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispectra.operators import svd as S
from lexispectra.runtime import stage
from lexispectra.sources import cooccurrence as C
from lexispectra.sources.cooccurrence import (
    read_cooccurrence,
    read_cooccurrence_bin,
    write_cooccurrence,
    write_cooccurrence_bin,
)
from lexispectra.sources.embedding import write_embedding
from lexispectra.sources.vocabulary import read_vocabulary, write_vocabulary

CELLS = "row INT, col INT, val DOUBLE"


def parts(folder, suffix):
    return b"".join(p.read_bytes() for p in sorted(folder.glob(f"part-*{suffix}")))


def test_vocabulary_roundtrip(spark, tmp_path):
    words = ["nan", "null", "NA", "é", "日本"] + [f"w{i}" for i in range(3000)]
    rows = [(i, w, 10_000 - i) for i, w in enumerate(words, 1)]
    vocab = spark.createDataFrame(rows, "id INT, word STRING, count BIGINT").repartition(7)
    write_vocabulary(vocab, str(tmp_path / "vocab"))
    assert parts(tmp_path / "vocab", ".txt").decode() == "".join(f"{w} {n}\n" for _, w, n in rows)
    found = read_vocabulary(spark, str(tmp_path / "vocab"))
    assert [tuple(r) for r in found.orderBy("id").collect()] == rows


def test_vocabulary_ids_follow_the_lines_not_the_counts(spark, tmp_path):
    (tmp_path / "vocab.txt").write_bytes(b"b 1\r\na 5\nc 3")
    found = read_vocabulary(spark, str(tmp_path / "vocab.txt")).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "b", 1), (2, "a", 5), (3, "c", 3)]


def test_vocabulary_in_another_encoding(spark, tmp_path):
    (tmp_path / "vocab.txt").write_bytes("naïve 3\n€ 2\n".encode("cp1252"))
    found = read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert [r["word"] for r in found.orderBy("id").collect()] == ["naïve", "€"]
    write_vocabulary(found, str(tmp_path / "again"), "cp1252")
    assert parts(tmp_path / "again", ".txt") == (tmp_path / "vocab.txt").read_bytes()


def test_vocabulary_with_a_word_twice(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("a 3\nb 2\na 1\n")
    with pytest.raises(ValueError, match="more than once"):
        read_vocabulary(spark, str(tmp_path / "vocab.txt"))


def test_cooccurrence_bytes(spark, tmp_path):
    cells = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.25), (1, 1, 3.0)], CELLS)
    write_cooccurrence_bin(cells, str(tmp_path / "cooc"))
    expected = b"".join(struct.pack("<iid", *c) for c in [(1, 1, 3.0), (1, 2, 0.25), (2, 1, 0.5)])
    assert parts(tmp_path / "cooc", ".bin") == expected
    assert [p.name for p in (tmp_path / "cooc").iterdir() if not p.name.startswith("part-")] == []


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    value = F.when(F.col("id") == 777, F.raise_error(F.lit("no such cell")).cast("double")).otherwise(F.lit(1.0))
    cells = spark.range(1, 1000, numPartitions=6).select(F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), value.alias("val"))
    path = str(tmp_path / "cooc")
    with pytest.raises(Exception, match="no such cell"):
        write_cooccurrence_bin(cells, path)
    assert not (tmp_path / "cooc").exists()
    write_cooccurrence_bin(cells.where("row != 777"), path)
    assert read_cooccurrence_bin(spark, path).count() == 998


def test_attempts_that_do_not_count_are_dropped(spark, tmp_path):
    writer, path = C.RecordWriter(str(tmp_path / "cooc"), "_attempts-1"), tmp_path / "cooc"
    (path / "_attempts-1").mkdir(parents=True)
    for name in "abcd":
        (path / "_attempts-1" / name).write_bytes(name.encode())
    done = [C._Written(7, f"{path}/_attempts-1/a"), None, C._Written(2, None), C._Written(1, f"{path}/_attempts-1/c")]
    writer.commit(done)
    assert {p.name: p.read_bytes() for p in path.iterdir()} == {"part-00000.bin": b"c", "part-00001.bin": b"a"}


def test_an_empty_count_table_is_an_empty_folder(spark, tmp_path):
    write_cooccurrence_bin(spark.createDataFrame([], CELLS), str(tmp_path / "cooc"))
    assert list((tmp_path / "cooc").iterdir()) == []


def test_cooccurrence_roundtrip_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "READ_BYTES", 160)
    rng = np.random.default_rng(5)
    values = {(int(r), int(c)): float(v) for r, c, v in zip(*rng.integers(1, 90, (2, 3000)), rng.random(3000))}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], CELLS).repartition(5)
    path = (tmp_path / "cooc").as_uri()
    write_cooccurrence_bin(cells, path)
    assert {(r["row"], r["col"]): r["val"] for r in read_cooccurrence_bin(spark, path).collect()} == values
    with pytest.raises(FileExistsError):
        write_cooccurrence_bin(cells, path)


def test_single_file_with_a_cell_twice(spark, tmp_path):
    records = [(1, 2, 0.5), (1, 2, 0.25), (3, 1, 1.0)]
    (tmp_path / "cooccurrence.bin").write_bytes(b"".join(struct.pack("<iid", *r) for r in records))
    found = read_cooccurrence_bin(spark, str(tmp_path / "cooccurrence.bin")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 0.75), (3, 1, 1.0)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(row")


def test_files_in_rising_order_are_read_without_a_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "READ_BYTES", 32)
    cells = [(r, c, r / c) for r in range(1, 9) for c in (5, 1, 3)]
    write_cooccurrence_bin(spark.createDataFrame(cells, CELLS).repartition(3), str(tmp_path / "cooc"))
    found = read_cooccurrence_bin(spark, str(tmp_path / "cooc"))
    assert shuffles(found) == 0 and sorted(map(tuple, found.collect())) == sorted(cells)
    # A cell twice, side by side in two ranges, and records out of order.
    for records in ([(1, 1, 1.0), (1, 2, 0.5), (1, 2, 0.25), (3, 1, 1.0)], [(1, 1, 1.0), (2, 2, 0.5), (1, 3, 1.0), (1, 1, 0.5)]):
        (tmp_path / "one.bin").write_bytes(b"".join(struct.pack("<iid", *r) for r in records))
        found = read_cooccurrence_bin(spark, str(tmp_path / "one.bin"))
        assert shuffles(found) == 1 and found.count() == 3


def test_cells_travel_packed_and_keep_their_bits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TASK_CELLS", 250)
    rng = np.random.default_rng(8)
    ids = rng.permutation(60 * 60)[:3000]
    values = np.concatenate([rng.random(2990), [0.0, -0.0, np.inf, 5e-324, 1 / 3, -1e300, 1e-300, 2.0, 2.0, 2.0]])
    cells = [(int(i) // 60 + 2**31 - 60, int(i) % 60 + (1 if i % 2 else 2**31 - 60), float(v)) for i, v in zip(ids, values)]
    write_cooccurrence_bin(spark.createDataFrame(cells, CELLS).repartition(4), str(tmp_path / "cooc"))
    assert parts(tmp_path / "cooc", ".bin") == b"".join(struct.pack("<iid", *c) for c in sorted(cells, key=lambda c: c[:2]))
    assert len(list((tmp_path / "cooc").iterdir())) > 8


def test_one_cell_many_times_is_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TASK_CELLS", 100)
    cells = spark.range(1000).select(F.lit(4).alias("row"), F.lit(7).alias("col"), F.lit(0.5).alias("val"))
    write_cooccurrence_bin(cells, str(tmp_path / "cooc"))
    assert parts(tmp_path / "cooc", ".bin") == struct.pack("<iid", 4, 7, 0.5) * 1000
    assert [tuple(r) for r in read_cooccurrence_bin(spark, str(tmp_path / "cooc")).collect()] == [(4, 7, 500.0)]


def test_broken_file(spark, tmp_path):
    (tmp_path / "cooccurrence.bin").write_bytes(b"x" * 17)
    with pytest.raises(ValueError, match="16-byte"):
        read_cooccurrence_bin(spark, str(tmp_path / "cooccurrence.bin"))


def test_cooccurrence_table(spark, tmp_path):
    cells = spark.createDataFrame([(2, 1, 0.5)], CELLS)
    write_cooccurrence(cells, str(tmp_path / "cooc"))
    assert [tuple(r) for r in read_cooccurrence(spark, str(tmp_path / "cooc")).collect()] == [(2, 1, 0.5)]


def test_embedding_text(spark, tmp_path):
    rows = [(i, w, [0.123456789, -1.0]) for i, w in enumerate(["nan", "é"] + [f"w{i}" for i in range(500)], 1)]
    table = spark.createDataFrame(rows, "id INT, word STRING, vector ARRAY<DOUBLE>").repartition(6)
    write_embedding(table, str(tmp_path / "out"))
    expected = "".join(f"{w} 0.1234568 -1.0000000\n" for _, w, _ in rows)
    assert parts(tmp_path / "out", ".txt").decode() == expected


def test_stage_needs_a_shared_folder(spark, monkeypatch):
    from lexispectra import runtime

    root = runtime.stage_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert runtime.stage(spark.range(5).select(F.col("id")), "numbers").count() == 5


def test_staged_tables_can_be_dropped(spark, tmp_path):
    from lexispectra import runtime

    kept, gone = (runtime.write_staged(spark.range(3), n) for n in ("kept", "gone"))
    runtime.drop_staged(runtime.read_staged(spark, "id BIGINT", [gone]))
    assert runtime.read_staged(spark, "id BIGINT", [kept]).count() == 3
    with pytest.raises(Exception, match="gone"):
        spark.read.parquet(gone)
    spark.range(3).write.parquet(str(tmp_path / "other"))
    runtime.drop_staged(spark.read.parquet(str(tmp_path / "other")))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3


def test_pairs_once_are_staged_once_and_written_both_ways(spark, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(C, "stage", lambda df, name: staged.append(found := stage(df, name)) or found)
    monkeypatch.setattr(C, "drop_staged", lambda df: None)
    monkeypatch.setattr(C, "TASK_CELLS", 20)
    pairs = [(i, j, i + j / 7) for i in range(1, 12) for j in range(i, 12, 2)]
    table = spark.createDataFrame(pairs, CELLS)
    write_cooccurrence_bin(table, str(tmp_path / "cooc"), once=True)
    found = C.read_cooccurrence_records(spark, str(tmp_path / "cooc")).orderBy("position").drop("position").collect()
    whole = {(i, j): 2 * v if i == j else v for i, j, v in pairs} | {(j, i): v for i, j, v in pairs if i != j}
    assert [tuple(r) for r in found] == [(*k, v) for k, v in sorted(whole.items())]
    assert [s.count() for s in staged] == [len(pairs)]


@pytest.mark.parametrize("kind", ["BIGINT", "DOUBLE", "DECIMAL(36,18)"])
def test_rows_of_packed_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "TASK_CELLS", 30)
    monkeypatch.setattr(C, "CUT_POINTS", 30)
    monkeypatch.setattr(S, "ROW_PIECE", 4)
    cells = {(r, c): r * 100 + c for r in range(1, 30) for c in range(1, 15) if (r + c) % 3}
    table = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row INT, col INT, val INT")
    made = S.sparse_rows(table.repartition(5).withColumn("val", F.col("val").cast(kind)), "val")
    found = made.collect()
    assert made.schema["vals"].dataType.simpleString().upper() == f"ARRAY<{kind}>"
    expected = {}
    for (r, c), v in sorted(cells.items()):
        expected.setdefault((r, (c - 1) // 4), []).append((c, v))
    assert {(r["row"], r["piece"]): list(zip(r["cols"], map(int, r["vals"]))) for r in found} == expected
    assert len(found) == len(expected)
    packed = "places" in made._jdf.queryExecution().executedPlan().toString()
    assert packed == ("DECIMAL" not in kind)
