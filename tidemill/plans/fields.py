"""Queries of single fields of payloads, and of sources that are fetched or decoded.

Payloads are written from customers in every shape a field comes in; the SQL says what each shape is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans import feeds
from tidemill.plans.catalog import pick
from tidemill.plans.registry import query, t
from tidemill.sources import boards, fetch, pdf
from tidemill.storage import fresh_path

_DATES = {
    "2026-01-02T03:04:05Z": "2026-01-02 03:04:05", "2026-01-02T03:04:05+05:30": "2026-01-01 21:34:05", "2026-01-02T03:04:05.250000+00:00": "2026-01-02 03:04:05.25", "2026-01-02": "2026-01-02 00:00:00",
    "2026-01-02T03:04:05": "2026-01-02 03:04:05", "yesterday": None, "": None, "2026-13-40T00:00:00Z": None,
}


def one(spark, d, name: str, fields: dict):
    """Items with one job each, made of customers, parsed by a source: all of them, usable or not."""
    rows = t(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("slug"), F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), *[c.alias(k) for k, c in fields.items()])).alias("payload"))
    items = rows.select(F.lit(name).alias("source"), F.get_json_object("payload", "$.id").alias("source_id"), "slug", "payload")
    return boards.get(name).parse(items, feeds.companies(spark, d))


@query("d1_iso_dates", f"SELECT CAST(c_custkey AS VARCHAR) AS source_id, CAST({pick(list(_DATES.values()), 'c_custkey')} AS TIMESTAMP) AS posted_at FROM customer")
def _(spark, d):
    got = one(spark, d, "ashby", {"publishedAt": F.expr(pick(list(_DATES), "c_custkey"))})
    return got.select("source_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("d2_epoch_millis", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE c_custkey % 4 WHEN 0 THEN make_timestamp(c_custkey * 1000000000) WHEN 1 THEN make_timestamp(1767225600000000) END AS posted_at FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    created = F.when(k % 4 == 0, (k * 1000000).cast("string")).when(k % 4 == 1, "1767225600000").when(k % 4 == 2, "soon")
    got = one(spark, d, "lever", {"createdAt": created})
    return got.select("source_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("d3_first_date", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '2026-01-01' WHEN 1 THEN TIMESTAMP '2026-02-02' WHEN 2 THEN TIMESTAMP '2026-02-02' END AS posted_at FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 4
    fields = {"first_published": F.when(k == 0, "2026-01-01T00:00:00Z").when(k == 1, ""), "updated_at": F.when(k < 3, "2026-02-02T00:00:00Z")}
    return one(spark, d, "greenhouse", fields).select("source_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("d11_nested_fields", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A; B' WHEN 2 THEN 'B' END AS location, c_custkey % 5 = 4 AS usable FROM customer WHERE c_nationkey % 5 <> 4")
def _(spark, d):
    k = F.col("c_custkey") % 5
    place = lambda c: F.struct(c.alias("location"))
    more = F.when(k == 1, F.array(place(F.lit(" B ")), place(F.lit(None).cast("string")))).when(k == 2, F.array(place(F.lit("")), place(F.lit("B"))))
    address = F.when(k == 3, F.struct(F.lit(None).cast("struct<addressCountry:string>").alias("postalAddress"))).when(k == 4, F.struct(F.struct(F.lit("India").alias("addressCountry")).alias("postalAddress")))
    got = one(spark, d, "ashby", {"title": F.lit("Data Engineer"), "location": F.when(k < 2, "A"), "secondaryLocations": more, "address": address})
    return got.where("company is not null").select("source_id", "location", "usable")


_LINES = ["Acme | ML Engineer | Pune, India | $120k<p>more | of it", "<b>Acme</b> &amp; co|Dev|REMOTE", "Is anyone | ", "just prose<br>a | b", "A | B<br>c | d", " | x | | y | "]
_PARTS = ["Acme;ML Engineer;Pune, India;$120k", "Acme & co;Dev;REMOTE", "Is anyone", "just prose", "A;B", "x;y"]


@query("t16_header_parts", f"SELECT c_custkey, {pick(_PARTS, 'c_custkey')} AS parts FROM customer")
def _(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", boards.header_parts(F.expr(pick(_LINES, "c_custkey"))).alias("p"))
    return rows.select("c_custkey", F.array_join("p", ";").alias("parts"))


@query("t17_stitched_description", """SELECT CAST(c_custkey AS VARCHAR) AS source_id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'intro' ELSE '' END, '<h3>' || c_mktsegment || '</h3><li>x</li>', CASE WHEN c_custkey % 3 = 0 THEN '<h3></h3>' END, CASE WHEN c_custkey % 5 = 0 THEN 'end' END], lambda x: coalesce(x, '') <> ''), chr(10)) AS html FROM customer""")
def _(spark, d):
    k, part = F.col("c_custkey"), lambda a, b: F.struct(a.alias("text"), b.alias("content"))
    none = F.lit(None).cast("string")
    lists = F.when(k % 3 == 0, F.array(part(F.col("c_mktsegment"), F.lit("<li>x</li>")), part(none, none))).otherwise(F.array(part(F.col("c_mktsegment"), F.lit("<li>x</li>"))))
    return one(spark, d, "lever", {"description": F.when(k % 2 == 0, "intro"), "lists": lists, "additional": F.when(k % 5 == 0, "end")}).select("source_id", "html")


@query("t18_rebuilt_pay", """SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey = 0 THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN format('${:,} - ${:,} per year', c_custkey * 10, c_custkey * 20) WHEN 1 THEN format('${:,} per year', c_custkey * 10) WHEN 2 THEN format('${:,} per year', c_custkey * 20) WHEN 3 THEN format('${:,} per year', c_custkey * 10) END END AS salary_raw FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    low = F.when(k % 5 == 2, 0).otherwise(F.when(k % 5 < 4, k * 10))
    high = F.when(k % 5 == 0, k * 20).when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, k * 20).when(k % 5 == 3, k * 10).otherwise(0)
    return one(spark, d, "remoteok", {"salary_min": low, "salary_max": high}).select("source_id", "salary_raw")


@query("t19_unescaped_html", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 2 = 0 THEN '<p>' || c_name || ' &amp; co</p>' ELSE '<b>\"é\"</b>' END AS html FROM customer")
def _(spark, d):
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("&lt;p&gt;"), "c_name", F.lit(" &amp;amp; co&lt;/p&gt;"))).otherwise("&lt;b&gt;&quot;&eacute;&#34;&#x3c;/b&gt;")
    return one(spark, d, "greenhouse", {"content": body}).select("source_id", "html")


@query("p5_gates", f"WITH {feeds._JOBS} " + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS usable FROM j WHERE coalesce({feeds._USABLE[n]}, false)" for n in boards.DEFAULTS))
def _(spark, d):
    out = None
    for name in boards.DEFAULTS:
        part = feeds.parsed(spark, d, name).where("usable").groupBy("source").agg(F.count("*").alias("usable"))
        out = part if out is None else out.unionByName(part)
    return out


_KNOWN = " UNION ALL ".join(f"SELECT '{n}' AS source, {s.by_company} AS by_company, {n in boards.DEFAULTS} AS standard" for n, s in boards.SOURCES.items())


@query("s1_sources", f"{_KNOWN} UNION ALL SELECT 'nowhere', NULL, NULL")
def _(spark, d):
    def known(name: str):
        try:
            return name, boards.get(name).by_company, name in boards.DEFAULTS
        except KeyError:
            return name, None, None

    return spark.createDataFrame([known(n) for n in (*boards.SOURCES, "nowhere")], "source string, by_company boolean, standard boolean")


@query("s3_fetched_boards", "SELECT 'n' || n_nationkey AS slug, CASE WHEN n_nationkey % 5 < 4 THEN n_name END AS name, n_nationkey % 5 = 4 AS failed FROM nation")
def _(spark, d):
    at, rows = fresh_path(spark, "boards"), t(spark, d, "nation")
    there = rows.where("n_nationkey % 5 < 4").select(F.concat(F.lit("n"), "n_nationkey").alias("slug"), "n_name")
    # Whole files under names that the address can spell: one directory a board, one file in each.
    there.select("slug", F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value")).coalesce(1).write.partitionBy("slug").text(at)
    root, _, rest = spark.read.text(at).inputFiles()[0].partition("/slug=")
    address = f"{root}/slug={{slug}}/{rest.split('/')[1]}"  # all files of one task have one name
    found = fetch.boards(spark, address, [f"n{r.n_nationkey}" for r in rows.collect()], 1)
    return found.select("slug", F.get_json_object("payload", "$.name").alias("name"), F.col("error").isNotNull().alias("failed"))


@query("s21_pdf_text", "SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'Profile of ' || n_name || chr(10) || 'Python SQL' WHEN 1 THEN 'Profile of ' || n_name || chr(10) || 'Python SQL' END AS text, CASE n_nationkey % 4 WHEN 2 THEN 'encrypted' WHEN 3 THEN 'no PDF, or a damaged one' END AS error FROM nation")
def _(spark, d):
    n, k = t(spark, d, "nation"), F.col("n_nationkey") % 4
    shown = F.concat(F.lit("BT /F1 12 Tf 72 700 Td (Profile of "), "n_name", F.lit(") Tj 0 -14 Td [(Py) -20 (thon) -300 (SQL)] TJ ET"))
    lock = F.when(k == 2, "3 0 obj << /Encrypt 4 0 R >> endobj\n").otherwise("")
    whole = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length 9 >>\nstream\n"), shown, F.lit("\nendstream\nendobj\n"), lock, F.lit("%%EOF"))
    data = F.when(k == 3, F.substring(whole, 1, 20)).otherwise(whole).cast("binary")
    return n.select(F.col("n_name").alias("name"), pdf.read(data).alias("r")).select("name", "r.text", "r.error")
