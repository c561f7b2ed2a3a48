"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lexispectra.llm import urls


def url_filter() -> str:
    """The walks are summed step by step; a step without any link left is the last."""
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed),
hosts AS (
  SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0.0 END) AS allow,
    avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0.0 END) AS block
  FROM ruled WHERE host <> '' GROUP BY host),
found AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1)), '{urls.UPPER}', '{urls.LOWER}') AS dst
  FROM parsed WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS walk, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
shares AS (SELECT walk, src, dst, {urls.DAMPING} * n / sum(n) OVER (PARTITION BY walk, src) AS share FROM both_ways),
steps(step, walk, host, part, whole) AS (
  SELECT 0, walk, host, {1 - urls.DAMPING} * CASE walk WHEN 'trust' THEN allow ELSE block END, {1 - urls.DAMPING}::DOUBLE
  FROM hosts, (VALUES ('trust'), ('distrust')) AS w(walk) WHERE allow > 0 OR block > 0
  UNION ALL
  SELECT step + 1, walk, dst, sum(share * part), sum(share * whole) FROM steps JOIN shares USING (walk) WHERE src = host AND whole >= {urls.TOLERANCE * (1 - urls.DAMPING)} GROUP BY ALL),
scores AS (SELECT walk, host, round(sum(part) / sum(whole), 9) AS score FROM steps GROUP BY ALL),
judged AS (SELECT host, coalesce(max(score) FILTER (walk = 'trust'), 0) AS trust, coalesce(max(score) FILTER (walk = 'distrust'), 0) AS distrust FROM scores GROUP BY host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN distrust - trust >= {urls.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)"""


def warc() -> str:
    """DuckDB has the hash as hex; five digits of base 32 are taken from each 25 bits of it."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) || '' AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h"""


def near_duplicates() -> str:
    """All pairs that share a shingle, and the closure of their links."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n"""


def decontamination() -> str:
    """All windows of documents and items, joined on their content."""
    lower = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({lower}, {word}) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[r.i : r.i + 9], ' ') AS content, least(len(w), 10) AS n
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, r.i AS start, array_to_string(w[r.i : r.i + n - 1], ' ') AS content
  FROM d, sizes, unnest(range(1, len(w) + 1)) AS r(i) WHERE r.i + n - 1 <= len(w)),
hits AS (SELECT DISTINCT doc_id, start, n, item_id FROM dw JOIN iw USING (content, n)),
covered AS (SELECT doc_id, count(DISTINCT p.p) AS n_hit FROM hits, unnest(range(start, start + n)) AS p(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def substrings() -> str:
    """All windows counted by content."""
    return """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, r.i AS start, md5(array_to_string(w[r.i : r.i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p.p FROM win JOIN again USING (h), unnest(range(start, start + 35)) AS p(p)),
numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM numbered ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def common_lines() -> str:
    """Documents counted for each stripped line."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS number FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{urls.UPPER}', '{urls.LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY doc_id"""


def search() -> str:
    """Every document scored for every item that shares a term with it."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
sized AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, totals GROUP BY term, n_docs),
impacts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN weights USING (term) JOIN sized USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


def collocations() -> str:
    """All phrases of one to five words, counted."""
    lower = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
    return f"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({lower}, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents)),
grams AS MATERIALIZED (
  SELECT lang, w[r.i : r.i + k.k - 1] AS g, count(*) AS f
  FROM p, unnest(range(1, 6)) AS k(k), unnest(range(1, len(w) + 1)) AS r(i) WHERE r.i + k.k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cuts AS MATERIALIZED (SELECT lang, g, f, c.c AS c FROM grams, unnest(range(1, 5)) AS c(c) WHERE c.c < len(g)),
scored AS (
  SELECT cuts.lang, cuts.g, cuts.f AS a, c, x.f AS l, y.f AS r, n,
    ((1000::HUGEINT * cuts.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.g = cuts.g[1 : c] JOIN grams y ON y.lang = cuts.lang AND y.g = cuts.g[c + 1 : len(cuts.g)] JOIN totals ON totals.lang = cuts.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
covered AS (
  SELECT lang, g[1 : len(g) - 1] AS g, f FROM grams WHERE len(g) > 2 UNION SELECT lang, g[2 : len(g)], f FROM grams WHERE len(g) > 2),
alone AS (SELECT *, array_to_string(g, ' ') AS phrase FROM least WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.lang = least.lang AND x.g = least.g AND x.f >= least.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone QUALIFY rank <= 2000"""
