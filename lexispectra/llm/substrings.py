"""Substring dedup: every window of a document is looked up in an indexed reference block of the corpus itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.text import Block, blocks, mix, span_hashes
from lexispectra.runtime import stage

#: Words of a window, and of the k-grams among which each window has an anchor.
WINDOW, GRAM = 35, 8
#: Phrases that a reference block holds, and places of an anchor beyond which its phrases are dealt to several blocks.
BLOCK, HOT = 10_000, 2_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` values in a row, by doubling."""
    width = 1
    while 2 * width <= size:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor, and number of places of the anchor, for every phrase.

    The anchor of a window is its k-gram of the smallest hash, so equal windows have
    equal anchors wherever they stand. A phrase is a run of windows with the same anchor;
    if it holds the anchor at several places, it may repeat itself.
    """
    at, grams = block.windows(GRAM)
    n = len(block.words)
    windows = at[at + WINDOW <= block.first[1:][block.doc[at]]] if n else at
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64), windows
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    hashes = np.zeros(n, np.uint64)
    hashes[at] = grams
    packed = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    packed[at] = (grams & ~low) | at.astype(np.uint64)
    place = (_least(packed, WINDOW - GRAM + 1)[windows] & low).astype(np.int64)
    anchor = hashes[place]
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (anchor[1:] != anchor[:-1])
    moved = np.ones(len(windows), np.int64)
    moved[1:] = place[1:] != place[:-1]
    starts = np.flatnonzero(new)
    return windows[starts], windows[np.append(starts[1:], len(windows)) - 1], anchor[starts], np.add.reduceat(moved | new, starts)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            first, _, anchor, places = phrases(block)
            part = batch.slice(block.rows.start, len(block))
            owner = pa.array(block.doc[first])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(owner), part.column("th").take(owner), pa.array(anchor.view(np.int64)), pa.array(places.astype(np.int64))], ["id", "th", "anchor", "places"]
            )


def factors(hashes: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block looked up in the block: source of each window, or -1, and where runs of equal windows begin.

    ``hashes`` has two rows, which together identify a window; ``follows`` marks
    windows that continue the one before. The index is the sorted hashes; a window's source
    is the next equal one, in a circle. A run goes on while the next window's source is the next place of
    the same source. Each window is looked up on its own, so none is missed where a run ends.
    """
    n = hashes.shape[1]
    order = np.lexsort((hashes[1], hashes[0]))
    same = (hashes[:, order[1:]] == hashes[:, order[:-1]]).all(0)
    group_start = np.flatnonzero(np.append(True, ~same)) if n else np.zeros(0, np.int64)
    source = np.full(n, -1, np.int64)
    if n:
        source[order[:-1][same]] = order[1:][same]
        size = np.diff(np.append(group_start, n))
        many = size > 1
        source[order[group_start[many] + size[many] - 1]] = order[group_start[many]]
    begins = source >= 0
    goes_on = follows.copy()
    if n:
        goes_on[0] = False
        goes_on[1:] &= (source[1:] == source[:-1] + 1) & begins[:-1]
    return source, begins & ~goes_on


_FOUND = "id BIGINT, th BIGINT, start INT, stop INT, h1 BIGINT, h2 BIGINT, alone BOOLEAN"


def _parse(table: pa.Table) -> pa.Table:
    """Look up the windows of one reference block's phrases in all of it.

    Gives the word spans of the runs found; for phrases of hot anchors also each distinct
    window once, since other blocks may hold the same.
    """
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks() if isinstance(table.column(name), pa.ChunkedArray) else table.column(name)
    first, dealt, rows, hashes, follows = column("first").to_numpy(), column("dealt").to_numpy(zero_copy_only=False), [], [], []
    at_word = []
    for block in blocks(column("text")):
        at, h1 = block.windows(WINDOW)
        rows.append(block.doc[at] + block.rows.start)
        at_word.append(first[rows[-1]] + at - block.first[block.doc[at]])
        hashes.append(np.stack([h1, span_hashes(mix(block.words ^ _SECOND), at, at + WINDOW)]))
        follows.append(np.append(False, (np.diff(at) == 1) & (np.diff(block.doc[at]) == 0))[: len(at)])
    row, word = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, at_word))
    both = np.concatenate([np.zeros((2, 0), np.uint64), *hashes], 1)
    source, begins = factors(both, np.concatenate([np.zeros(0, bool), *follows]))
    held = source >= 0
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    lengths = np.bincount(run[held], minlength=len(starts))
    start = word[starts]
    stop = start + lengths - 1 + WINDOW
    # One row of each distinct window of dealt phrases: the first place of it in the block.
    mine = np.flatnonzero(dealt[row])
    _, one = np.unique(both[:, mine], axis=1, return_index=True) if len(mine) else (None, np.zeros(0, np.int64))
    one = mine[one]
    owner = pa.array(np.append(row[starts], row[one]))
    nothing = pa.nulls(len(starts), pa.int64())
    return pa.table(
        {
            "id": column("id").take(owner),
            "th": column("th").take(owner),
            "start": pa.array(np.append(start, word[one]).astype(np.int32)),
            "stop": pa.array(np.append(stop, word[one] + WINDOW).astype(np.int32)),
            "h1": pa.concat_arrays([nothing, pa.array(both[0, one].view(np.int64))]),
            "h2": pa.concat_arrays([nothing, pa.array(both[1, one].view(np.int64))]),
            "alone": pa.array(np.append(np.zeros(len(starts), bool), source[one] < 0)),
        }
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns _n_words and _n_removed, and as text the words that are kept, joined by one space.

    A word goes if a window of 35 words around it also starts anywhere else, in the same
    document or another, as the texts were given.

    1. Every phrase of every text sends its anchor; anchors found at one place only
       cannot belong to a repeated window, and their phrases are done.
    2. The other phrases go to the reference block of their anchor. A block holds all phrases
       of its anchors, as text, and each of their windows is looked up in it.
    3. Phrases of an anchor with more than HOT places are dealt to several blocks, and their
       distinct windows, one for each block, are counted across blocks.

    Texts without a repeat keep their text as it was. Null texts have no words and stay null;
    rows that repeat id and text repeat each other. Windows are told apart by 128 bits of hashes of their words.
    """
    n = len(docs.columns)
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    ids, texts = place[id_col], place[text_col]
    # Rows are known by hashes of id and text, neither ever null; rows that share both share their repeats.
    keys = {"id": F.xxhash64(F.col(ids)), "th": F.xxhash64(F.coalesce(F.col(texts).cast("string"), F.lit("")))}
    named = docs.toDF(*place.values()).withColumns(keys)
    plain = named.select("id", "th", F.col(texts).cast("string").alias("text"))
    spark = docs.sparkSession
    # The same exchange serves both joins below, so both take all its columns.
    moved = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "th")

    seen = plain.mapInArrow(_anchors, "id BIGINT, th BIGINT, anchor BIGINT, places BIGINT")
    shared = stage(seen.groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1"), "anchors")
    size = shared.agg(F.sum("places").alias("all"), F.max("places").alias("most")).first()
    n_blocks = max(1, -(-(size["all"] or 0) // BLOCK))
    listed = seen.select("id", "th", "anchor").join(shared, "anchor").groupBy("id", "th").agg(F.collect_set(F.struct("anchor", "places")).alias("anchors"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("anchors")
            for block in blocks(batch.column(texts)):
                first, last, anchor, _ = phrases(block)
                doc = block.doc[first]
                part = listed.slice(block.rows.start, len(block))
                flat = part.flatten()
                known = flat.field("anchor").to_numpy().view(np.uint64)
                count = flat.field("places").to_numpy()
                owner = np.repeat(np.arange(len(block)), pa.compute.list_value_length(part).to_numpy())
                # Phrases whose anchor is listed for their document, by a search in sorted pairs.
                pair = mix(known ^ mix(owner.astype(np.uint64)))
                order = np.argsort(pair)
                wanted = mix(anchor ^ mix(doc.astype(np.uint64)))
                at = np.minimum(np.searchsorted(pair[order], wanted), max(len(order) - 1, 0))
                kept = np.flatnonzero(pair[order][at] == wanted) if len(order) else np.zeros(0, np.int64)
                first, last, anchor, doc, count = first[kept], last[kept], anchor[kept], doc[kept], count[order][at[kept]] if len(kept) else np.zeros(0, np.int64)
                parts = -(-count // HOT)
                # From the row's own keys and the word's place in it, so a task that runs again deals alike.
                keys = [batch.column(name).to_numpy().view(np.uint64)[doc + block.rows.start] for name in ("id", "th")]
                salt = mix(keys[0] ^ mix(keys[1] ^ mix((first - block.first[doc]).astype(np.uint64)))) % np.maximum(parts, 1).astype(np.uint64)
                target = mix(anchor + salt * _SECOND) % np.uint64(n_blocks)
                starts, ends = block.bounds
                data = block.data.tobytes()
                pieces = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[last + WINDOW - 1].tolist())]
                rows = pa.array(doc + block.rows.start)
                word = (first - block.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(word), pa.array(target.astype(np.int64)), pa.array(parts > 1), pa.array(pieces, pa.string())],
                    ["id", "th", "first", "block", "dealt", "text"],
                )

    with_anchors = moved.join(listed, ["id", "th"]).select(*place.values(), "id", "th", "anchors")
    cut_up = with_anchors.mapInArrow(cut, "id BIGINT, th BIGINT, first INT, block BIGINT, dealt BOOLEAN, text STRING")
    found = cut_up.groupBy("block").applyInArrow(_parse, _FOUND)
    spans = found.where(F.col("h1").isNull()).select("id", "th", "start", "stop")
    if (size["most"] or 0) > HOT:
        across = found.where(F.col("h1").isNotNull())
        again = across.groupBy("h1", "h2").agg(F.count("*").alias("blocks")).where("blocks > 1")
        spans = spans.unionByName(across.where("alone").join(again, ["h1", "h2"]).select("id", "th", "start", "stop"))
    removed = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    result = moved.join(removed, ["id", "th"], "left").select(*place.values(), "spans")
    schema = ", ".join(f"`{place[f.name]}` {f.dataType.simpleString()}" for f in docs.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(texts), batch.column("spans")
            kept, n_words, n_removed = [], [], []
            for block in blocks(text):
                part = spans.slice(block.rows.start, len(block))
                flat = part.flatten()
                lengths = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy()
                first = block.first[np.repeat(np.arange(len(block)), lengths)]
                edges = np.zeros(len(block.words) + 1, np.int64)
                if len(flat):
                    np.add.at(edges, first + flat.field("start").to_numpy(), 1)
                    np.add.at(edges, first + flat.field("stop").to_numpy(), -1)
                stays = np.cumsum(edges)[:-1] == 0
                words = block.word_bytes(np.flatnonzero(stays))
                ends = np.append(0, np.cumsum(stays))[block.first]
                given = text.slice(block.rows.start, len(block))
                for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                    whole = b - a == block.first[i + 1] - block.first[i]
                    kept.append(given[i].as_py() if whole else b" ".join(words[a:b]).decode())
                n_words.append(np.diff(block.first))
                n_removed.append(np.diff(block.first) - np.diff(ends))
            if batch.num_rows:
                columns = [pa.array(kept, pa.string()) if name == texts else batch.column(name) for name in place.values()]
                counts = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_words, n_removed)]
                yield pa.RecordBatch.from_arrays([*columns, *counts], [*place.values(), "n_words", "n_removed"])

    parsed = result.mapInArrow(keep, f"{schema}, n_words BIGINT, n_removed BIGINT")
    return parsed.toDF(*docs.columns, "_n_words", "_n_removed")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    found = remove_repeats(docs.select(id_col, text_col), id_col, text_col)
    spaced = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+", " "), F.lit(" "))
    return found.select(id_col, F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(spaced, 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the kept words as text; ``chars_col``, where there is one, follows a changed text."""
    found = remove_repeats(docs, id_col, text_col)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        length = F.char_length(F.col(text_col)).cast(kind)
        found = found.withColumn(chars_col, F.when(F.col("_n_removed") > 0, length).otherwise(F.col(chars_col)))
    return found.select(*docs.columns)
