"""Quality, near duplicates, substrings and decontamination next to plain Python."""

import base64
import random
import re

import naive_llm as naive
import numpy as np
import pytest

from lexispectra.llm import decontaminate, near, quality, substrings

random.seed(4)  # for PASSAGE; each test has numbers of its own
WORDS = ["Ab", "cd", "é", "of", "THE", "x1", "#y", "zz,", "ß", "qu"]


def prose(n, words=None):
    return " ".join(random.choices(words or WORDS, k=n))


def fresh(n):
    return " ".join("".join(random.choices("abcdefghij", k=7)) for _ in range(n))


def test_quality_measures(docs, rows):
    texts = [None, "", " \n\t", "one", prose(200), "a b\na b\n\n a b\na b", "x y z x y z q", fresh(400) + "\n" + fresh(300), "\x0b\x0c é#é\r\n é#é", fresh(40000), "Ber " * 5000]
    found = rows(quality.quality(docs(texts)))
    for i, text in enumerate(texts):
        words, (row,) = naive.split(text), found[i]
        lines = [x for x in (text or "").split("\n") if naive.split(x)]
        repeated = len(naive.repeated_words(words, 3))
        expected = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected, i
        assert row.base_failed == (len(words) < 50 or 100 * repeated > 50 * len(words))
        assert not (row.kept and row.base_failed)
    assert found[9][0].kept and found[7][0].kept and not found[10][0].kept


def test_quality_bands(docs):
    noise = " ".join(base64.b64encode(random.randbytes(48)).decode() for _ in range(200))
    repetitive = " ".join(f"{fresh(1)} " + "word goes round and round again " * 3 for _ in range(4))
    texts = [fresh(600), noise, ("lorem ipsum " * 30 + "\n") * 40, repetitive]
    kept = [r.doc_id for r in quality.keep_good(docs(texts)).collect()]
    assert 0 in kept and 1 not in kept and 2 not in kept


def test_quality_keeps_columns_and_empty_tables(docs, spark):
    given = docs([fresh(300), None])
    assert quality.keep_good(given).schema == given.schema
    assert quality.quality(given.limit(0)).count() == 0


def edited(text, share):
    return " ".join(w if random.random() > share else fresh(1) for w in text.split(" "))


def test_good_documents_leave_a_batch_block_by_block(spark, docs, monkeypatch):
    real, sizes = quality.blocks, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(quality, "blocks", lambda texts: real(texts, 3000))

    def whole(*args):
        sizes.add(1)
        raise AssertionError("a whole batch was measured at once")

    monkeypatch.setattr(quality, "_measured", whole)
    text = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(random.randrange(900)) for _ in range(90))
    texts = [None, text, "short", "", text + " more words", None, text] * 6
    given = docs(texts).coalesce(1)
    assert [r.doc_id for r in quality.keep_good(given).collect()] == [i for i, t in enumerate(texts) if t and len(t) > 99]
    assert sizes.value == 0


def test_near_duplicates(docs, rows):
    base, chain = fresh(120), [fresh(80)]
    for _ in range(6):
        chain.append(edited(chain[-1], 0.02))
    texts = [None, "", "  ", "a", "A", "a b c", "a b c d", base, base.upper(), *[edited(base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2)], *chain, fresh(9), prose(30), prose(30), fresh(30000)]
    ids = list(range(100, 100 + len(texts)))
    random.shuffle(ids)
    found = rows(near.near_duplicates(docs(texts, ids)))
    expected = naive.near_components(list(zip(ids, texts)))
    for i, text in zip(ids, texts):
        (row,) = found[i]
        assert (row.n_shingles, row.component_id, row.kept) == (len(naive.shingles(text)), expected[i], expected[i] == i)


def test_near_duplicates_of_null_and_repeated_ids(docs, rows):
    text = fresh(60)
    other = fresh(60)
    given = docs([text, text, text, text, other, None, None], [None, 5, 5, 9, 9, None, 4])
    found = rows(near.near_duplicates(given))
    assert [(r.component_id, r.kept) for r in found[None]] == [(None, True)] * 2
    assert [(r.component_id, r.kept) for r in found[5]] == [(5, True)] * 2
    assert sorted((r.component_id, r.kept) for r in found[9]) == [(5, False), (9, True)]
    kept = near.keep_one(given)
    assert kept.columns == given.columns
    # Rows that repeat id and text are one; the two rows without id are the text and a null.
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(False, 0, text), (True, 5, text), (True, 9, other), (False, 0, ""), (True, 4, "")])
    assert near.near_duplicates(given.limit(0)).count() == 0


def test_a_text_that_shares_the_id_of_a_near_copy_stays(docs):
    """(5, T), (9, T + more) are linked; (9, unrelated) and (5, T + even more) have ids of others."""
    text, unrelated = fresh(60), fresh(50)
    given = docs([text, text + " more", unrelated, text + " and more"], [5, 9, 9, 5])
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(given).collect())
    assert found == [(5, 56, 5, True), (5, 58, 5, True), (9, 46, 9, True), (9, 57, 5, False)]
    kept = near.keep_one(given).collect()
    assert len(kept) == 2 and (9, unrelated) in {(r.doc_id, r.text) for r in kept} and {r.doc_id for r in kept} == {5, 9}


def test_near_duplicates_of_texts_repeated_many_times(docs, rows):
    base = fresh(60)
    texts = [base] * 300 + [edited(base, 0.01)] * 300 + [fresh(60)]
    found = rows(near.near_duplicates(docs(texts, [1] * 300 + [2] * 300 + [3])))
    assert {r.component_id for r in found[1] + found[2]} == {1} and len(found[2]) == 300 and found[3][0].kept
    assert near.keep_one(docs(texts, [1] * 300 + [2] * 300 + [3])).count() == 2


def test_near_duplicates_in_cut_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(near, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(near, "CLUSTER_BLOCK", 3)
    base = fresh(100)
    texts = [edited(base, 0.02) for _ in range(30)] + [fresh(50)]
    found = rows(near.near_duplicates(docs(texts)))
    expected = naive.near_components(list(enumerate(texts)))
    assert {i: r[0].component_id for i, r in found.items()} == expected


def test_min_max_signature_estimates_similarity():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1250, dtype=np.uint64)
    a, b = np.sort(hashes[:1000]), np.sort(hashes[250:])  # similarity 0.6
    agree = [(near.signatures(x, np.array([0, len(x)]))[0] == near.signatures(y, np.array([0, len(y)]))[0]).mean() for x, y in [(a, b), (a, a)]]
    assert abs(agree[0] - 0.6) < 0.15 and agree[1] == 1


PASSAGE = fresh(60)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK", 20)
    copies = [f"{fresh(random.randint(0, 40))} {PASSAGE}\n{fresh(random.randint(0, 40))}" for _ in range(8)]
    own = fresh(40)
    texts = [None, "", " ", "a b", fresh(34), fresh(35), *copies, PASSAGE, " ".join(PASSAGE.split()[10:45]), " ".join(PASSAGE.split()[10:44])]
    texts += [f"{own} x {own}", "same " * 34, "same " * 36, "the the " * 300, fresh(20000), f"{PASSAGE} {PASSAGE}", "  tab\tand\nline  "]
    given = docs(texts)
    found = rows(substrings.remove_repeats(given))
    for i, (n_words, n_removed, words) in enumerate(naive.without_repeats(texts)):
        (row,) = found[i]
        assert (row._n_words, row._n_removed, naive.split(row.text)) == (n_words, n_removed, words), i
        assert n_removed or row.text == texts[i]
    changed = substrings.without_repeats(given)
    assert changed.columns == given.columns
    assert all(r.n_chars == (len(r.text) if found[r.doc_id][0]._n_removed else 1) for r in changed.collect())


def test_substrings_of_repeated_rows_and_null_ids(docs, rows):
    text = fresh(50)
    found = rows(substrings.digests(docs([text, text, fresh(50), text + " x", fresh(40)], [1, 1, 1, None, None])))
    assert sorted(r.n_removed for r in found[1]) == [0, 50, 50]
    assert sorted(r.n_removed for r in found[None]) == [0, 50]
    assert substrings.digests(docs([])).count() == 0


def contaminated(text, items, n=10):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = find((text or "").translate(naive.LOWER))
    hit, found = set(), set()
    for item, content in items:
        parts = find((content or "").translate(naive.LOWER))
        if item is None or not parts:
            continue
        size = min(n, len(parts))
        wanted = set(naive.windows(parts, size))
        for i, w in enumerate(naive.windows(words, size)):
            if w in wanted:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination(docs, rows, spark, monkeypatch, small):
    import hashlib

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", small)
    long, short = fresh(25), "Two Words"
    items = [(1, long), (10, short), (2, "the of the of the of the of the of the of"), (3, None), (4, ""), (None, fresh(12)), (5, long), (5, long), (6, "ΟΔΟΣ. É ÀÇ ΣΑΣ.Α x y z 1 2 3 4")]
    part = long.split()
    texts = [None, "", long.upper(), "x " + " ".join(part[3:13]) + " y", " ".join(part[3:12]), "a two, WORDS! two words", "the of " * 40, fresh(5000) + " " + "-".join(part), "οδος. É ÀÇ ΣΑΣ.Α x y z 1 2 3 4", "ΟΔΟΣ. É ÀÇ ΣΑΣ.Α X y z 1 2 3 4", fresh(50)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id BIGINT, text STRING, word STRING")
    given = docs(texts)
    found = rows(decontaminate.contamination(given, bench))
    clean = []
    for i, text in enumerate(texts):
        n_words, n_hit, listed = contaminated(text, items)
        (row,) = found[i]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n_words, n_hit, len(listed.split(",")) if listed else 0, n_hit > 0), i
        assert row.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        clean += [i] * (not n_hit)
    kept = decontaminate.keep_clean(given, bench)
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.collect()) == clean
    assert decontaminate.contamination(given.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(given, bench.limit(0)).collect()} == {0}


def test_decontamination_of_repeated_and_null_ids(docs, rows, spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id BIGINT, text STRING")
    found = rows(decontaminate.contamination(docs(["one two three", "one two", "one two three", None], [1, 1, None, None]), bench))
    assert sorted(r.n_hit for r in found[1]) == [0, 3] and sorted(r.n_hit for r in found[None]) == [0, 3]


def test_bands_of_small_sets_agree_as_often_as_those_of_large_ones():
    """Sets of 4 shingles and 3 of them: 0.75 ** 4 of the bands; 0.5 ** 2 if a band had both ends of a permutation."""
    hashes = np.sort(np.random.default_rng(4).integers(0, 1 << 63, (2000, 4), dtype=np.uint64), 1)
    four = near.band_keys(near.signatures(hashes.reshape(-1), np.arange(0, 8001, 4)))
    three = near.band_keys(near.signatures(hashes[:, :3].reshape(-1), np.arange(0, 6001, 3)))
    assert (four == three).mean() == pytest.approx(0.75**4, abs=0.02)


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_texts_of_clusters_are_found_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(near, "BROADCAST_NODES", most)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:58])), (3, " ".join(words[::-1])), (4, None)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
