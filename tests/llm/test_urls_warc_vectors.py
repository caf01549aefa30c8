import base64
import gzip
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from fieldhub.llm import pivots, urls, warc

ODD_URLS = [
    (1, "https://WWW.Example.ORG/en/1"), (2, "http://example.org/es/x"), (3, "http://a.com/fr/"), (4, "http://a.com/de/q?x#y"),
    (5, None), (6, ""), (7, "no scheme.org/"), (8, "ftp://notorg/x"), (9, "http://org"), (10, "http://org/"),
    (11, "http://x.org?/en/1"), (12, "http://ÄÖ.com/fr/ü"), (13, "a://b://c.org/es/"), (None, "http://z.org/"), (13, "a://b://c.org/es/"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(*r, 1, "x") for r in ODD_URLS], "page_id long, url string, _spelled int, _host string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(ODD_URLS)
    by = {r["_id"]: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in rows}
    assert by[1] == ("www.example.org", "/en/1", "example.org/en/1", "block")
    assert by[2][2:] == ("example.org/es/", "block") and by[3][2:] == ("com/fr/", "allow") and by[4][1:] == ("/de/q", "com/de/", "block")
    assert by[5][:3] == by[6][:3] == by[7][:3] == ("", "", None)
    assert by[8][2] is None and by[9][:3] == ("org", "", None) and by[10][2:] == ("org/", "allow")
    assert by[11][:3] == ("x.org", "", None) and by[12][0] == "ÄÖ.com" and by[13][:3] == ("b:", "//c.org/es/", None)


def test_no_urls(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    undecided = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r["_verdict"] for r in urls.judge(undecided).collect()} == {"allow"}


def test_ratio_tells_the_languages_apart(spark):
    rows = [(i, f"http://h{i % 7}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(400)]
    rows += [(1_000 + i, f"http://k{i}.net/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("_id >= 1000").collect()
    assert all((r["_verdict"] == "allow") == (r["_id"] % 2 == 1) for r in found)


def test_every_plan_is_native(spark, sf):
    plan = urls.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d/", ""),
            (5, "http://e/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nö"), (6, "http://f/", "<p>same</p>"), (7, "u", "x" * 300_000),
            (8, "http://g/", "line\r\n\r\nline"), (None, "n", "lone")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, _payload string")
    found = {r["_id"]: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        same = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        first = i == same
        assert found[i] == (len((html or "").encode()), digest(html), "response" if first else "revisit", None if first else same)


def test_repeated_and_nameless_pages_keep_their_rows(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (2, "v", "same"), (None, None, "lone"), (None, None, "lone"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(((r["_id"], r["_type"], r["_refers_to"], r["_bytes"]) for r in warc.round_trip(pages).collect()), key=repr)
    assert found == sorted([(1, "revisit", 2, 4)] * 2 + [(2, "response", None, 4)] * 2 + [(None, "response", None, 4)] * 2
                           + [(None, "response", None, 0)], key=repr)


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.createDataFrame([(i, f"u{i}", f"{i}" * 2_000) for i in range(60)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "a").rglob("*.gz")]
    assert len(sizes) >= 8 and max(sizes) < 120_000
    assert warc.captures(spark, str(tmp_path / "a")).count() == 60


def test_small_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx")], "page_id long, url string, html string")
    assert {r["_type"] for r in warc.round_trip(pages, min_bytes=3).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_captures_of_foreign_archives(spark, tmp_path):
    """Per-record gzip, a capture without request, an orphan and a repeated record."""
    def record(kind, name, block, **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items())]
        lines = "\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"])
        return gzip.compress(f"{lines}\r\n\r\n".encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    answer = record("response", "r1", http, Content_Type="application/http; msgtype=response")
    (tmp_path / "a.warc.gz").write_bytes(
        record("warcinfo", "i", b"software: x") + answer + answer + record("request", "q1", b"GET /", WARC_Concurrent_To="<r1>")
        + record("request", "q0", b"GET /0", WARC_Concurrent_To="<r1>") + record("metadata", "m9", b"a: b", WARC_Concurrent_To="<gone>")
        + record("response", "r2", http, Content_Type="application/http"))
    found = {r["capture_id"]: r for r in warc.captures(spark, str(tmp_path)).collect()}
    assert set(found) == {"<r1>", "<r2>"}
    assert found["<r1>"]["request"]["record_id"] == "<q0>" and found["<r1>"]["metadata"] is None
    assert found["<r1>"]["response"]["payload_bytes"] == 4 and found["<r2>"]["request"] is None


def brute_vectors(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    near = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= least} for i in unit}
    out = {}
    for i in {i for i, _ in rows if i is not None}:
        seen, stack = {i}, [i]
        while stack:
            stack += [k for k in near.get(stack.pop(), ()) if k not in seen and not seen.add(k)]
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_vectors_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] * (1 + i % 3) + draw.normal(size=32) * (0.1 if i % 60 < 20 else 0.33)).tolist()) for i in range(700)]
    rows += [(700 + i, centres[0].tolist()) for i in range(50)]
    rows += [(800, None), (801, [0.0] * 32), (802, [math.nan] * 32), (803, [None] + [1.0] * 31), (804, []), (None, centres[0].tolist())]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, _n int")
    wanted = brute_vectors(rows)
    found = {r["_id"]: tuple(r)[1:] for r in pivots.near_vectors(table).collect()}
    assert found.pop(None) == (0, None, False)
    true = sum(n for n, _, _ in wanted.values())
    assert sum(n for n, _, _ in found.values()) >= 0.98 * true
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    exact = [i for i in wanted if i >= 700]
    assert all(found[i][2] == wanted[i][2] for i in exact)


def test_links_inside_a_crowd(spark):
    """A third of 30,000 vectors are near (not equal) copies of one."""
    draw = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    crowd = unit(unit(draw.normal(size=(1, 64))) + draw.normal(size=(10_000, 64)) * 0.024)
    pairs = np.repeat(unit(draw.normal(size=(5_000, 64))), 2, axis=0)
    values = np.vstack([crowd, unit(pairs + draw.normal(size=pairs.shape) * 0.018), unit(draw.normal(size=(10_000, 64)))])
    wanted = np.concatenate([(values[i : i + 2_000] @ values.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(values), 2_000)])
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(values)), "embedding": list(values)}))
    found = {r["_id"]: r for r in pivots.near_vectors(table).collect()}
    counts = np.array([found[i]["_links"] for i in range(len(values))])
    assert (counts <= wanted).all()
    assert counts[:10_000].sum() >= 0.99 * wanted[:10_000].sum() > 0
    assert counts[10_000:].sum() >= 0.99 * wanted[10_000:].sum() > 0
    assert len({found[i]["_component"] for i in range(10_000) if wanted[i]}) == 1


def test_vectors_of_several_lengths(spark):
    draw = np.random.default_rng(6)
    rows = []
    for size in (2, 8, 33):
        for k in range(120):
            base = draw.normal(size=size)
            rows += [(len(rows), base.tolist()), (len(rows) + 1, (base * 2 + draw.normal(size=size) * 0.05).tolist())]
    rows += [(5_000, [1.0, 2.0, 3.0]), (5_001, [2.0, 4.0, 6.0]), (5_002, [1.0]), (5_003, [-1.0]), (5_004, [3.0])]
    wanted = brute_vectors_by_length(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["_id"]: tuple(r)[1:] for r in pivots.near_vectors(table).collect()}
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(n for n, _, _ in found.values()) >= 0.98 * sum(n for n, _, _ in wanted.values())
    assert found[5_000] == (1, 5_000, True) and found[5_001] == (1, 5_000, False) and found[5_004] == (1, 5_002, False)


def brute_vectors_by_length(rows):
    out = {}
    for size in {len(v) for _, v in rows}:
        out |= brute_vectors([r for r in rows if len(r[1]) == size])
    return out


def test_a_length_without_pivots_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(pivots, "_pivots", lambda classes: {})
    draw = np.random.default_rng(7)
    rows = [(i, (draw.normal(size=4) * (1 if i < 60 else 0.1) + (i % 2)).tolist()) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["_id"]: tuple(r)[1:] for r in pivots.near_vectors(table).collect()} == brute_vectors(rows)


def test_descriptions_are_ordered():
    cosines = np.array([[0.5, 0.9, 0.85, 0.79], [0.2, 0.1, 0.2, 0.15]])
    many, near = pivots._ordered(cosines)
    assert many.tolist() == [2, 4] and near.tolist() == [1, 2, 0, 2, 3, 1]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.near_vectors(none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in pivots.near_vectors(one).collect()) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]
