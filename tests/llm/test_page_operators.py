"""URL filters and archives."""

import base64
import hashlib
import random
import struct
import uuid

import naive_llm as naive
import pytest
import zstandard

from lexispectra.llm import urls, warc

@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", None) for r in rows], "page_id BIGINT, url STRING, html STRING, host STRING, score DOUBLE")

    return make


URLS = {
    "http://net/": ("net", "/", "net/", "block"),
    "http://A.B.NET/x": ("a.b.net", "/x", "net/", "block"),
    "http://a.net": ("a.net", "", None, "allow"),
    "http://example.net/en/": ("example.net", "/en/", "example.net/en/", "allow"),
    "http://sub.example.net/en/x?q#f": ("sub.example.net", "/en/x", "example.net/en/", "allow"),
    "http://sub.example.net/en?": ("sub.example.net", "/en", "net/", "block"),
    "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "x://y.org/fr/a://b": ("y.org", "/fr/a://b", "org/fr/", "allow"),
    "//no.scheme/": ("", "", None, "allow"),
    "http://É.com?x/y": ("É.com", "", None, "allow"),
    "http://dotnet/": ("dotnet", "/", None, "allow"),
    "://q.net/a\nb#c": ("q.net", "/a\nb", "net/", "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_hosts_paths_and_rules(pages):
    found = {r.page_id: r for r in urls.judge(pages([(i, u, None) for i, u in enumerate(URLS)])).collect()}
    for i, (url, expected) in enumerate(URLS.items()):
        row = found[i]
        assert (row["host"], row["path"], row["rule"]) == expected[:3], url
        assert row["rule"] is None or row["verdict"] == expected[3], url


def test_propagation_over_links(pages):
    hosts = [f"h{i}.com" for i in range(8)] + ["bad.net", "good.org", "part.example.com", "worse.net"]
    edges, rows = {}, []
    for i in range(220):
        a = random.choice(hosts)
        links = random.choices(["bad.net", "worse.net", "h1.com"] if a in ("h1.com", "h2.com", "h3.com") else hosts, k=random.randint(0, 3))
        path = random.choice(["/fr/", "/de/"]) if a in ("good.org", "part.example.com") else "/"
        html = "".join(f'<A HREF="{random.choice(["http:", "https:", ""])}//{b.upper()}/x">y</a> <a href="/own">z</a>' for b in links)
        rows.append((i, f"http://{a}{path}", html or None))
        for b in links:
            if a != b:
                edges[a, b] = edges.get((a, b), 0) + 1
    found = urls.judge(pages(rows)).collect()
    seeds = {"allow": {}, "block": {}, "any": {}}
    for h in {r.host for r in found}:
        own = [r for r in found if r.host == h]
        shares = {v: sum(r.rule is not None and r.verdict == v for r in own) / len(own) for v in ("allow", "block")}
        if sum(shares.values()):
            seeds["any"][h] = 1
            for v, x in shares.items():
                seeds[v][h] = x
    back = {(b, a): n for (a, b), n in edges.items()}
    ratio = lambda graph, v: {h: x / w for (h, x), w in zip(sorted(naive.page_rank(graph, seeds[v], urls.DAMPING, 200).items()), [w for _, w in sorted(naive.page_rank(graph, seeds["any"], urls.DAMPING, 200).items())])}
    trust, distrust = ratio(edges, "allow"), ratio(back, "block")
    verdicts = set()
    for r in found:
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert r.trust == pytest.approx(t, abs=1e-4) and r.distrust == pytest.approx(d, abs=1e-4)
        if r.rule is None and abs(d - t - urls.THRESHOLD) > 1e-3:
            assert r.verdict == ("block" if d - t >= urls.THRESHOLD else "allow")
            verdicts.add((r.host, r.verdict))
    assert {v for _, v in verdicts} == {"allow", "block"}


@pytest.mark.parametrize("linkers", [1, 2, 5, 40])
def test_verdicts_do_not_follow_the_size_of_the_graph(pages, linkers):
    """Hosts that link only to a blocked host, and hosts that also link to an allowed one."""
    rows = [(0, "http://bad.net/", None), (1, "http://good.org/fr/", "".join(f'<a href="//fine{i}.com/">' for i in range(linkers)))]
    for i in range(linkers):
        rows.append((10 + i, f"http://only{i}.com/", '<a href="http://bad.net/">'))
        rows.append((100 + i, f"http://fine{i}.com/", '<a href="http://bad.net/"> <a href="//good.org/">'))
        rows.append((200 + i, f"http://further{i}.com/", f'<a href="//only{i}.com/">'))
        rows.append((300 + i, f"http://alone{i}.com/", None))
    found = {r.page_id: r.verdict for r in urls.judge(pages(rows)).collect()}
    for i in range(linkers):
        assert [found[k + i] for k in (10, 100, 200, 300)] == ["block", "allow", "block", "allow"], i


@pytest.mark.parametrize("linked", [False, True])
def test_against_sql(pages, tmp_path, linked):
    import duckdb

    from lexispectra.llm import oracles

    rows = [(i, f"http://{random.choice(['x.net', 'a.com', 'b.com', 'c.org', 'www.example.com'])}{random.choice(['/fr/', '/de/', '/'])}", f'<a href="http://{random.choice(["x.net", "a.com", "b.com", "c.org"])}/">' if linked else None) for i in range(60)]
    given = pages(rows).select("page_id", "url", "html")
    given.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    expected = sorted(con.sql(f"SELECT page_id, verdict FROM ({oracles.url_filter()})").fetchall())
    assert sorted((r.page_id, r.verdict) for r in urls.judge(given).collect()) == expected


def test_url_filter_of_repeated_rows_and_empty_tables(pages):
    given = pages([(1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (None, "http://b.com/", None)])
    assert urls.judge(given).count() == 3
    assert urls.judge(given.limit(0)).count() == 0


PAGES = [
    (5, "http://a/", "<p>same</p>"),
    (3, "http://b/\r\nX-Evil: 1", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (4, "http://c/", None),
    (2, "http://d/", ""),
    (7, "http://e/é", "unique é 漢字 \r\n\r\n end\r\n\r\n"),
    (8, "", "x" * 3_000_000),
    (None, "http://f/", "<p>same</p>"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, pages, tmp_path, least):
    many = [(100 + i, f"http://m/{i}", f"<html><body><p>page {i} {random.random()}</p></body></html>" * 20) for i in range(400)]
    folder = str(tmp_path / uuid.uuid4().hex)
    warc.write_warc(pages(PAGES + many).repartition(3), folder, min_bytes=least)
    found = {r.id: r for r in warc.read_warc(spark, folder).collect()}
    first = {}
    for i, _, html in PAGES + many:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    assert len(found) == len(PAGES) + len(many)
    for i, url, html in PAGES + many:
        row, text = found[i], html or ""
        again = len(text.encode()) >= least and first[text] != i
        assert (row.payload_bytes, row.payload_digest) == (len(text.encode()), digest(html))
        assert (row.record_type, row.refers_to) == (("revisit", first[text]) if again else ("response", None))
        assert row.payload == (None if again else text)
        assert row.url == (url if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))
    archives = list((tmp_path / folder).glob("*.warc.zst"))
    heads = [struct.unpack("<I", p.read_bytes()[:4])[0] for p in archives]
    assert heads and set(heads) == {0x184D2A5D}  # one long page does not keep an archive from its dictionary


def test_archive_of_an_empty_table(pages):
    assert warc.warc_round_trip(pages(PAGES).limit(0)).count() == 0


def test_broken_records_are_refused():
    good = warc._record(1, "http://a/", b"payload", None, "2024-01-01T00:00:00Z")
    fields, block = warc.parse_record(good)
    assert warc.parse_payload(fields, block) == (7, digest("payload"), b"payload")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"), good.replace(b"WARC-Date", b"Warc Date"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_cut_archives_and_foreign_frames(tmp_path):
    import pyarrow as pa

    squeeze = zstandard.ZstdCompressor()
    data = squeeze.compress(b"one") + struct.pack("<II", 0x184D2A50, 3) + b"abc" + squeeze.compress(b"two" * 1000)
    assert list(warc.records(pa.BufferReader(data))) == [b"one", b"two" * 1000]
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(data[:-3])))
