"""The pipeline next to a brute-force version of its stages."""

import random
import re
import zlib

import naive_llm as naive
import numpy as np
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from lexispectra.llm.encoder import tokenizer_path
from lexispectra.llm.quality import Bands
from lexispectra.runtime import stage

random.seed(15)


def fresh(n):
    return " ".join("".join(random.choices("abcdefghij", k=random.randint(3, 9))) for _ in range(n))


def good(text, bands=Bands()):
    words, data = naive.split(text), (text or "").encode()
    if len(words) < 50 or 100 * len(naive.repeated_words(words, 3)) > 50 * len(words):
        return False

    def ratio(part):
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(part)) / len(part)

    low, high = max([(-1, 0, 9), *(x for x in bands.limits if x[0] <= len(data))])[1:]
    out = 0
    if len(data) >= 4096:
        for i in range(0, len(data), 4096):
            own, chunk = data[i : i + 4096], data[min(i, len(data) - 4096) :][:4096]
            out += 0 if bands.chunk_limits[0] <= ratio(chunk) <= bands.chunk_limits[1] else len(own) / len(data)
    return low <= ratio(data) <= high and out <= bands.chunk_share


def holds(text, items):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = find(text.translate(naive.LOWER))
    for item in items:
        parts = find(item.translate(naive.LOWER))
        size = min(10, len(parts))
        if set(naive.windows(parts, size)) & set(naive.windows(words, size)):
            return True
    return False


def brute_force(rows, items):
    rows = [(i, t) for i, t in rows if good(t)]
    component = naive.near_components(rows)
    rows = [(i, t) for i, t in rows if component[i] == i]
    cut = naive.without_repeats([t for _, t in rows])
    rows = [(i, t if not gone else " ".join(kept)) for (i, t), (_, gone, kept) in zip(rows, cut)]
    return [(i, t) for i, t in rows if not holds(t, items)]


def corpus():
    passage, item, base = fresh(60), fresh(20), fresh(150)
    texts = [None, "", fresh(20), "spam " * 300, *[fresh(random.randint(60, 600)) for _ in range(25)]]
    texts += [f"{fresh(80)} {passage} {fresh(80)}" for _ in range(4)]
    texts += [base, base, base + " more", " ".join(w if random.random() > 0.01 else "other" for w in base.split())]
    texts += [f"{fresh(70)} {item.upper()} {fresh(70)}", f"{fresh(70)} {' '.join(item.split()[:9])} {fresh(70)}", fresh(9000)]
    return list(enumerate(texts)), [item, fresh(12)]


def test_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute_force(rows, items)
    assert 25 < len(expected) < 36

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, apply in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    kept = docs.collect()
    assert sorted((r.doc_id, r.text) for r in kept) == expected
    assert all(r.n_chars == len(r.text) for r in kept)

    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    pieces = set()
    for i, text in expected:
        ids = np.array([*encode(text, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        pieces |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == pieces and len(found) == len(pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
