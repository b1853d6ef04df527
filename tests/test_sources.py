"""Boards, fetching with retries, PDF text."""

import json
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.sources import boards, fetch, pdf

JOB = {"id": 1, "title": " Data Engineer ", "location": {"name": " Pune "}, "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05Z", "absolute_url": "u"}
SENT = {
    "greenhouse": {"jobs": [JOB, JOB | {"id": 2, "title": "Cook"}, JOB | {"id": 3, "location": {"name": "Paris"}}, JOB | {"id": None}, JOB | {"id": 4, "title": " "}, JOB | {"id": 5, "first_published": "2026-01-01T00:00:00Z"}]},
    "lever": [
        {"id": "a", "text": "ML lead", "categories": {"location": "X", "allLocations": ["Pune", "", "Goa"]}, "description": "d", "lists": [{"text": "l", "content": "c"}], "additional": "e", "createdAt": 1000, "workplaceType": "remote", "applyUrl": "v"},
        {"id": "b", "text": "ML lead", "categories": {"location": " Goa "}, "createdAt": "x"},
        {"id": "c", "text": None, "categories": {"location": "Goa"}},
    ],
    "ashby": {"jobs": [
        {"id": "a", "title": "AI dev", "location": "Berlin", "secondaryLocations": [{"location": " Pune "}], "isListed": True, "isRemote": True, "descriptionPlain": "p"},
        {"id": "b", "title": "AI dev", "location": "X", "address": {"postalAddress": {"addressCountry": "India"}}, "descriptionHtml": "<p>h</p>"},
        {"id": "c", "title": "AI dev", "location": "Pune", "isListed": False},
    ]},
    "remoteok": [{"legal": "x"}, {"id": "7", "company": "C", "position": "P", "salary_min": 50000, "salary_max": 60000}, {"id": "8", "company": "C"}, {"id": "9", "company": "C", "position": "P", "salary_min": 0, "salary_max": 70000}],
    "hackernews": {"id": 1, "children": [
        {"id": 2, "text": "Acme | ML Engineer | Remote, EU | $120k-150k<p>more", "created_at": "2026-01-02T03:04:05Z"}, {"id": 3, "text": "no header"}, {"id": 4, "text": None}, {"id": 5, "text": "x" * 90 + " | y"},
    ]},
}


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([(p, "co", "Co & Sons") for p in boards.DEFAULTS], "provider string, slug string, name string")


def parsed(spark, companies, name):
    raw = spark.createDataFrame([("co", json.dumps(SENT[name])), ("bad", "{"), ("none", None), ("unknown", json.dumps(SENT[name]))], "slug string, payload string")
    items = boards.get(name).items(raw)
    return items, boards.get(name).parse(items, companies)


def usable(df):
    return {r.source_id: r for r in df.where("usable").collect()}


def test_greenhouse(spark, companies):
    items, rows = parsed(spark, companies, "greenhouse")
    assert items.where("slug = 'co'").count() == 5 and json.loads(items.first().payload)["title"] == " Data Engineer "
    got = usable(rows)
    assert set(got) == {"co:1", "co:5"}  # of an unknown board nothing is usable
    assert (got["co:1"].title, got["co:1"].company, got["co:1"].location, got["co:1"].html) == ("Data Engineer", "Co & Sons", "Pune", "<p>a &amp; b</p>")
    assert str(got["co:5"].posted_at)[:10] == "2026-01-01"
    assert boards.skipped(rows).first().asDict() == {"source": "greenhouse", "fetched": 10, "skipped": 8}
    silver = boards.silver(rows).where("source_id = 'co:1'").first()
    assert silver.description == "a & b" and silver.location == "Pune" and silver.salary_min is None and len(silver.content_hash) == 64


def test_lever(spark, companies):
    got = usable(parsed(spark, companies, "lever")[1])
    assert set(got) == {"co:a", "co:b"}
    assert (got["co:a"].location, got["co:a"].html, got["co:a"].url, got["co:a"].remote_hint) == ("Pune; Goa", "d\n<h3>l</h3>c\ne", "v", True)
    assert got["co:b"].location == "Goa" and got["co:b"].posted_at is None and got["co:a"].posted_at == datetime(1970, 1, 1, 0, 0, 1)


def test_ashby(spark, companies):
    got = usable(parsed(spark, companies, "ashby")[1])
    assert {k: (r.location, r.html, r.remote_hint) for k, r in got.items()} == {"co:a": ("Berlin; Pune", "p", True), "co:b": ("X", "<p>h</p>", False)}


def test_remoteok(spark, companies):
    got = usable(parsed(spark, companies, "remoteok")[1])
    assert {k: r.salary_raw for k, r in got.items()} == {"7": "$50,000 - $60,000 per year", "9": "$70,000 per year"}
    assert got["7"].url.endswith("/7") and got["7"].remote_hint


def test_thread(spark, companies):
    _, rows = parsed(spark, companies, "hackernews")
    got = usable(rows)
    assert {k: (r.company, r.title, r.location, r.salary_raw, r.remote_hint) for k, r in got.items()} == {"2": ("Acme", "ML Engineer", "Remote, EU", "$120k-150k", True)}
    s = boards.silver(rows).first()
    assert (s.salary_min_year, s.salary_max_year, s.is_remote) == (120000, 150000, True)


def test_all_sources_together(spark, companies):
    items = None
    for name in boards.SOURCES:
        own = parsed(spark, companies, name)[0]
        items = own if items is None else items.unionByName(own)
    rows = boards.parsed(items, companies)
    assert rows.count() == items.count()
    a = {r.board: r for r in boards.audit(rows.where("source = 'greenhouse'"), spark.createDataFrame([("gone", "failed")], "board string, status string")).collect()}
    assert (a["co"].jobs_total, a["co"].jobs_in_india, a["co"].jobs_kept, a["co"].status) == (5, 4, 2, "ok") and (a["gone"].jobs_total, a["gone"].status) == (0, "failed")
    assert boards.parsed(items.limit(0), companies).count() == 0
    with pytest.raises(KeyError):
        boards.get("x")


def test_retry_wait():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert [fetch.retry_wait(h, 7.0, now) for h in ("3", "999", "-4", "x", None, "nan", "Thu, 01 Jan 2026 00:00:09 GMT", "Wed, 31 Dec 2025 23:00:00 GMT")] == [3.0, 60.0, 0.0, 7.0, 7.0, 7.0, 9.0, 0.0]


def test_get_json_tries_again():
    def opener(*answers):
        left = list(answers)

        def one(address):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return one

    waits = []
    assert fetch.get_json("u", opener=opener((503, {}, b""), OSError("down"), (200, {}, b'{"a": 1}')), sleep=waits.append) == {"a": 1} and waits == [2.0, 4.0]
    waits.clear()
    assert fetch.get_json("u", {"q": "a b"}, opener=lambda a: (200, {}, json.dumps(a).encode())) == "u?q=a+b"
    assert fetch.get_json("u", opener=opener((429, {"Retry-After": "1"}, b""), (200, {}, b"1")), sleep=waits.append) == 1 and waits == [1.0]
    with pytest.raises(RuntimeError, match="404"):
        fetch.get_json("u", opener=opener((404, {}, b"")), sleep=waits.append)
    with pytest.raises(RuntimeError, match="3 attempts"):
        fetch.get_json("u", opener=opener(*[(500, {}, b"")] * 3), sleep=lambda s: None)


def test_boards_are_read_in_parallel(spark, tmp_path):
    (tmp_path / "co.json").write_text(json.dumps(SENT["greenhouse"]))
    (tmp_path / "bad.json").write_text("{")
    got = {r.slug: r for r in fetch.boards(spark, f"file://{tmp_path}/{{slug}}.json", ["co", "bad", "none"], 1).collect()}
    assert json.loads(got["co"].payload) == SENT["greenhouse"] and got["co"].error is None
    assert got["bad"].payload is None and got["bad"].error and got["none"].error


def a_pdf(stream: bytes, packed: bool = True, more: bytes = b"") -> bytes:
    body = zlib.compress(stream) if packed else stream
    head = b"/Filter /FlateDecode " if packed else b""
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << " + head + b"/Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n" + more + b"trailer << /Root 1 0 R >>\n%%EOF"


SHOWN = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\366rld) Tj 0 -14 Td [(Py) -20 (thon) -300 (SQL)] TJ T* <416263> Tj ET"


def test_pdf(spark, tmp_path):
    assert pdf.pdf_text(a_pdf(SHOWN)) == pdf.pdf_text(a_pdf(SHOWN, False)) == ("Hello (big) wörld\nPython SQL\nAbc", None)
    bad = [None, b"", b"hello", a_pdf(SHOWN)[:20], a_pdf(SHOWN, more=b"3 0 obj << /Encrypt 4 0 R >> endobj\n"), a_pdf(b"q 1 0 0 1 0 0 cm Q"), a_pdf(SHOWN).replace(zlib.compress(SHOWN), b"broken" * 9)]
    assert [pdf.pdf_text(b)[1] for b in bad] == ["empty file", "empty file", "no PDF, or a damaged one", "no PDF, or a damaged one", "encrypted", "no text", "no PDF, or a damaged one"]
    assert len(pdf.pdf_text(a_pdf(b"BT (" + b"x" * 20000 + b") Tj ET"))[0]) == pdf.CHARS
    (tmp_path / "a.pdf").write_bytes(a_pdf(SHOWN))
    assert pdf.files(spark, str(tmp_path)).select(F.col("text").alias("t")).first().t.startswith("Hello")
