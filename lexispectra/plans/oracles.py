"""The same queries as SQL over the same tables, for checking by another engine."""

from __future__ import annotations

from lexispectra.functions.weights import WEIGHTINGS
from lexispectra.operators.svd import ROW_PIECE
from lexispectra.plans.queries import CUTOFF, MAX_VOCAB, MIN_COUNT, PARAMS, SHIFT, WINDOW

# All 1/d with d up to the window are whole multiples of 1/UNITS.
UNITS = 2520

_DOC = "doc_id, line_no"
_TALK = "conv_id, turn, line_no"


def _corpus(table: str, keys: str, prefix: str) -> str:
    """CTEs `{prefix}lines` and `{prefix}words`."""
    return f"""
    {prefix}lines AS (
        SELECT {keys}, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line
        FROM (SELECT {keys}, string_split(text, chr(10)) AS parts FROM {table})
    ),
    {prefix}words AS (
        SELECT * FROM (
            SELECT {keys}, line_no, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS word
            FROM (
                SELECT {keys}, line_no, string_split(replace(replace(line, chr(13), ''), chr(9), ' '), ' ') AS parts
                FROM {prefix}lines
            )
        ) WHERE word <> ''
    )"""


def _vocab(words: str) -> str:
    return f"""
    word_counts AS (SELECT word, count(*) AS "count" FROM {words} GROUP BY word),
    vocab AS (
        SELECT CAST(row_number() OVER (ORDER BY "count" DESC, word) AS INTEGER) AS id, word, "count"
        FROM word_counts WHERE "count" >= {MIN_COUNT}
    )"""


def _coded(words: str, keys: str, prefix: str) -> str:
    return f"""
    {prefix}coded AS (
        SELECT {keys}, pos, word, id,
            CAST(row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS INTEGER) AS position
        FROM {words} JOIN vocab USING (word)
    )"""


def _pairs(keys: str, prefix: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in names)
    out = ", ".join(f"b.{k}" for k in names)
    return f"""
    {prefix}pairs AS (
        SELECT {out}, b.pos, a.id AS left_id, b.id AS right_id, b.position - a.position AS distance
        FROM {prefix}coded a JOIN {prefix}coded b
        ON {same} AND b.position - a.position BETWEEN 1 AND {WINDOW}
    )"""


def _cells(prefix: str, value: str, symmetric: bool = True) -> str:
    pairs = f'SELECT left_id AS "row", right_id AS "col", distance FROM {prefix}pairs'
    if symmetric:
        pairs += f" UNION ALL SELECT right_id, left_id, distance FROM {prefix}pairs"
    return f"""
    {prefix}cells AS (SELECT "row", "col", {value} AS val FROM ({pairs}) GROUP BY "row", "col")"""


def _with(*parts: str, then: str) -> str:
    return f"WITH {','.join(parts)}\n{then}"


_INVERSE = f"CAST(sum({UNITS} // distance) AS DOUBLE) / {float(UNITS)}"
_SCALED = f"CAST(sum({UNITS} // distance) AS DOUBLE)"
_LINES = _corpus("documents", "doc_id", "d_")
_TALK_LINES = _corpus("conversations", "conv_id, turn", "c_")
_VOCAB = _vocab("d_words")
_CODED = _coded("d_words", _DOC, "d_")
_PAIRS = _pairs(_DOC, "d_")
_DOCS = (_LINES, _VOCAB, _CODED, _PAIRS)
_TALKS = (_TALK_LINES, _coded("c_words", _TALK, "c_"), _pairs(_TALK, "c_"))
_LONG = "(SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)"
_LONG_LINES = (_corpus(_LONG, "doc_id", "l_"), _vocab("l_words"), _coded("l_words", _DOC, "l_"), _pairs(_DOC, "l_"))
_RANKED = _with(_LINES, _VOCAB, then='SELECT id, word, "count" FROM vocab')
_SYMMETRIC = _with(*_DOCS, _cells("d_", _INVERSE), then="SELECT * FROM d_cells")
_ASYMMETRIC = (*_DOCS, _cells("d_", _SCALED, symmetric=False))

_WEIGHT = {
    0: "1e0",
    1: "1e0 / distance",
    2: "2e0 / (1e0 + distance)",
    3: "3e0 / (2e0 + distance)",
    4: "1e0 / sqrt(distance)",
}


def _weighting(code: int) -> str:
    parts = (_TALK_LINES, _vocab("c_words"), _coded("c_words", _TALK, "c_"), _pairs(_TALK, "c_"))
    return _with(*parts, _cells("c_", f"round(sum({_WEIGHT[code]}), 9)"), then="SELECT * FROM c_cells")


def _distance_weights() -> str:
    forms = " UNION ALL ".join(
        f"SELECT distance, n, {code} AS weighting, round({form}, 9) AS weight, round(({form}) * n, 3) AS mass FROM per"
        for code, form in _WEIGHT.items()
    )
    per = " per AS (SELECT CAST(distance AS INTEGER) AS distance, count(*) AS n FROM d_pairs GROUP BY distance)"
    return _with(*_DOCS, per, then=forms)


def _pmi(cutoff: float | None, shift: float | None) -> str:
    value = "log2(val / (total * (row_total / total) * (col_total / total)))"
    keep = "" if cutoff is None else f"WHERE pmi >= {cutoff}"
    moved = "pmi" if shift is None else f"pmi + {shift}"
    return _with(
        *_DOCS,
        _cells("d_", _SCALED),
        ' row_sums AS (SELECT "row", sum(val) AS row_total FROM d_cells GROUP BY "row")',
        ' col_sums AS (SELECT "col", sum(val) AS col_total FROM d_cells GROUP BY "col")',
        " all_sum AS (SELECT sum(val) AS total FROM d_cells)",
        f""" values_ AS (
            SELECT "row", "col", {value} AS pmi
            FROM d_cells JOIN row_sums USING ("row") JOIN col_sums USING ("col"), all_sum
        )""",
        then=f'SELECT "row", "col", round({moved}, 6) AS pmi FROM values_ {keep}',
    )


def _stats() -> str:
    metrics = {
        "tokens": 'SELECT CAST(sum("count") AS BIGINT) FROM word_counts',
        "distinct_words": "SELECT count(*) FROM word_counts",
        "vocabulary": "SELECT count(*) FROM vocab",
        "tokens_in_vocabulary": "SELECT count(*) FROM d_coded",
        "cells": "SELECT count(*) FROM pmi_cells",
        "cells_kept": f"SELECT count(*) FROM pmi_cells WHERE pmi >= {CUTOFF}",
    }
    head, cells = _pmi(None, None).rsplit("SELECT", 1)
    rows = " UNION ALL ".join(f"SELECT '{name}' AS metric, ({query}) AS value" for name, query in metrics.items())
    return f"{head.rstrip()}, pmi_cells AS (SELECT{cells}) {rows}"


def _kept_cells(then: str) -> str:
    """Something about the PMI table after cutoff and shift."""
    head, cells = _pmi(CUTOFF, SHIFT).rsplit("SELECT", 1)
    cells = cells.replace(f"round(pmi + {SHIFT}, 6)", f"pmi + {SHIFT}")
    return f"{head.rstrip()}, kept AS (SELECT{cells}) {then}"


_DESCRIBED = f"""
    SELECT id, word, {PARAMS.dimension} AS dimension, id IN (SELECT "row" FROM kept) AS has_vector FROM vocab"""


def _truncated() -> str:
    """The longest prefix of whole characters within 999 bytes, found by length."""
    stripped = "replace(replace(replace(text, chr(10), ''), chr(9), ''), ' ', '')"
    fitting = "list_filter(range(0, 1000), lambda n: strlen(left(word, CAST(n AS BIGINT))) <= 999)"
    return f"""
        SELECT doc_id, strlen(word) AS word_bytes, strlen(kept) AS kept_bytes, md5(kept) AS kept_md5
        FROM (
            SELECT doc_id, word,
                CASE WHEN strlen(word) <= 999 THEN word ELSE left(word, list_max({fitting})) END AS kept
            FROM (SELECT doc_id, {stripped} AS word FROM documents)
        )"""


def _merged() -> str:
    both = "SELECT * FROM d_cells UNION ALL SELECT * FROM c_cells"
    return _with(
        *_DOCS,
        *_TALKS,
        _cells("d_", _INVERSE),
        _cells("c_", _INVERSE),
        then=f'SELECT "row", "col", sum(val) AS val FROM ({both}) GROUP BY "row", "col"',
    )


ORACLES: dict[str, str] = {
    "corpus_lines": _with(_LINES, then="SELECT doc_id, line_no, line FROM d_lines"),
    "tokens": _with(_LINES, then="SELECT doc_id, line_no, pos, word FROM d_words"),
    "truncate_long_words": _truncated(),
    "word_count": _with(_LINES, _VOCAB, then='SELECT word, "count" FROM word_counts'),
    "vocab_min_count": _with(_LINES, _VOCAB, then='SELECT word, "count" FROM vocab'),
    "vocab_rank": _RANKED,
    "vocab_max_size": _with(
        _LINES,
        _VOCAB,
        f' largest AS (SELECT word, "count" FROM word_counts ORDER BY "count" DESC, md5(word) LIMIT {MAX_VOCAB})',
        then=f"""
        SELECT CAST(row_number() OVER (ORDER BY "count" DESC, word) AS INTEGER) AS id, word, "count"
        FROM largest WHERE "count" >= {MIN_COUNT}""",
    ),
    "vocab_roundtrip": _RANKED,
    "oov_filter": _with(_LINES, _VOCAB, _CODED, then="SELECT doc_id, line_no, pos, word FROM d_coded"),
    "encode_tokens": _with(_LINES, _VOCAB, _CODED, then="SELECT doc_id, line_no, pos, id FROM d_coded"),
    "line_position": _with(_LINES, _VOCAB, _CODED, then="SELECT doc_id, line_no, position, id FROM d_coded"),
    "context_window": _with(
        _LINES,
        _VOCAB,
        _CODED,
        then=f"""
        SELECT doc_id, line_no, pos, id, coalesce(array_to_string(list(id) OVER (
            PARTITION BY doc_id, line_no ORDER BY position ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING
        ), ' '), '') AS context FROM d_coded""",
    ),
    "window_pairs": _with(
        _LINES,
        _VOCAB,
        *_TALKS,
        then="""
        SELECT conv_id, turn, line_no, pos, left_id, right_id, CAST(distance AS INTEGER) AS distance FROM c_pairs""",
    ),
    "distance_weights": _distance_weights(),
    "cooc_symmetric": _SYMMETRIC,
    "cooc_asymmetric": _with(*_DOCS, _cells("d_", _INVERSE, symmetric=False), then="SELECT * FROM d_cells"),
    **{f"cooc_weighting_{code}": _weighting(code) for code in WEIGHTINGS},
    "cooc_given_vocab": _with(_LINES, _VOCAB, *_TALKS, _cells("c_", _INVERSE), then="SELECT * FROM c_cells"),
    "cooc_cut_lines": _with(*_LONG_LINES, _cells("l_", _INVERSE), then="SELECT * FROM l_cells"),
    "cooc_merge": _merged(),
    "cooc_roundtrip": _SYMMETRIC,
    "row_marginal": _with(*_ASYMMETRIC, then='SELECT "row", sum(val) AS row_total FROM d_cells GROUP BY "row"'),
    "col_marginal": _with(*_ASYMMETRIC, then='SELECT "col", sum(val) AS col_total FROM d_cells GROUP BY "col"'),
    "cooc_total": _with(*_ASYMMETRIC, then="SELECT sum(val) AS total FROM d_cells"),
    "matrix_shape": _with(*_ASYMMETRIC, then='SELECT max("row") AS n_rows, max("col") AS n_cols FROM d_cells'),
    "pmi": _pmi(None, None),
    "pmi_cutoff": _pmi(CUTOFF, None),
    "pmi_shift": _pmi(CUTOFF, SHIFT),
    "pipeline_stats": _stats(),
    "cooc_sorted": _with(*_DOCS, _cells("d_", _INVERSE), then="""
        SELECT row_number() OVER (ORDER BY "row", "col") - 1 AS position, * FROM d_cells"""),
    "reserved_word": _with(_LINES, then="""
        SELECT count(*) AS tokens, count(*) FILTER (word = '<unk>') AS reserved FROM d_words"""),
    "svd_residuals": _kept_cells(f"""
        SELECT CAST(r AS INTEGER) AS rank, true AS orthonormal, true AS exact, true AS stated, true AS falling, true AS within_norm,
            (SELECT round(sum(pmi * pmi), 2) FROM kept) AS norm FROM range(1, {PARAMS.dimension + 1}) AS t(r)"""),
    "embedding_words": _kept_cells(_DESCRIBED),
    "embedding_from_cooc_words": _kept_cells(_DESCRIBED),
    "embedding_text_parsed": _with(_LINES, _VOCAB, then=f"""
        SELECT id, word, {PARAMS.dimension} AS dimension, true AS seven_decimals, true AS equal FROM vocab"""),
    "sparse_rows": _with(
        *_DOCS,
        _cells("d_", f"CAST(sum({UNITS} // distance) AS BIGINT)"),
        then=f"""
        SELECT "row", CAST(("col" - 1) // {ROW_PIECE} AS INTEGER) AS piece,
            string_agg(CAST("col" AS VARCHAR), ' ' ORDER BY "col") AS cols,
            string_agg(CAST(val AS VARCHAR), ' ' ORDER BY "col") AS vals
        FROM d_cells GROUP BY 1, 2""",
    ),
}
