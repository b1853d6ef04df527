"""Queries of board feeds: payloads written from customers, and what their parsers must read.

A board is a nation, and each of its payloads holds up to 100 jobs. The SQL reads customers, never a
payload.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import history, runs
from tidemill.plans.catalog import pick
from tidemill.plans.places import _ROLES, _word
from tidemill.plans.registry import query, t
from tidemill.sources import boards

_TITLE = "CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN '  ' ELSE " + pick(_ROLES, "c_custkey") + " END"
_PLACE = "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE " + pick(["Pune", "Berlin", "Bangalore, India", "Remote - India", "Hyderabad, Pakistan", "NOIDA", "New York", "Goa"], "c_custkey // 3") + " END"
_STAMP = "'2026-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z'"
#: Companies are nations, by the slug n1, n2 and so on; every fifth isn't known.
_JOBS = f"""j AS (SELECT c_custkey AS id, 'n' || c_nationkey || ':' || c_custkey AS source_id, c_name, {_TITLE} AS title, {_PLACE} AS place, {_STAMP} AS stamp,
  CASE WHEN c_nationkey % 5 <> 4 THEN n_name END AS company FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _spark_sql(sql: str) -> str:
    return sql.replace(" // ", " div ").replace("AS VARCHAR", "AS STRING")


def jobs(spark, d):
    c = t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), "c_name", F.concat(F.lit("n"), "c_nationkey").alias("slug"), F.expr(_spark_sql(_TITLE)).alias("title"), F.expr(_spark_sql(_PLACE)).alias("place"), F.expr(_spark_sql(_STAMP)).alias("stamp"))


def companies(spark, d):
    known = t(spark, d, "nation").where("n_nationkey % 5 <> 4")
    return known.select(F.explode(F.array(*map(F.lit, boards.DEFAULTS))).alias("provider"), F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.col("n_name").alias("name"))


def payloads(rows, job, wrap: str | None):
    """raw(slug, payload): the jobs of a board, up to 100 in one payload."""
    own = rows.select("slug", (F.col("id") / 100).cast("long").alias("page"), job.alias("job"))
    lists = own.groupBy("slug", "page").agg(F.collect_list("job").alias("jobs"))
    return lists.select("slug", F.to_json(F.struct(F.col("jobs").alias(wrap)) if wrap else F.col("jobs")).alias("payload"))


def raw(spark, d, name: str):
    j, k = jobs(spark, d), F.col("id")
    place, title = F.col("place"), F.col("title")
    if name == "greenhouse":
        body = F.concat(F.lit("&lt;p&gt;"), "c_name", F.lit(" &amp;amp; co&lt;/p&gt;"))
        job = F.struct(k.alias("id"), title.alias("title"), F.struct(place.alias("name")).alias("location"), body.alias("content"), F.when(k % 2 == 0, F.col("stamp")).alias("first_published"), F.lit("2025-05-05T00:00:00Z").alias("updated_at"))
        return payloads(j, job, "jobs")
    if name == "lever":
        every = F.when(k % 2 == 0, F.array(place, F.lit(""), F.lit("Berlin")))
        lists = F.array(F.struct(F.lit("Skills").alias("text"), F.concat(F.lit("<li>"), "c_name").alias("content")))
        job = F.struct(k.cast("string").alias("id"), title.alias("text"), F.struct(place.alias("location"), every.alias("allLocations")).alias("categories"), F.lit("About us").alias("description"), lists.alias("lists"), (k * 1000).alias("createdAt"), F.when(k % 5 == 0, "remote").alias("workplaceType"))
        return payloads(j, job, None)
    if name == "ashby":
        more = F.when(k % 7 == 0, F.array(F.struct(F.lit(" Pune ").alias("location"))))
        address = F.when(k % 13 == 0, F.struct(F.struct(F.lit("India").alias("addressCountry")).alias("postalAddress")))
        job = F.struct(k.cast("string").alias("id"), title.alias("title"), place.alias("location"), more.alias("secondaryLocations"), F.when(k % 11 == 0, False).alias("isListed"), address.alias("address"), F.col("stamp").alias("publishedAt"), F.col("c_name").alias("descriptionPlain"))
        return payloads(j, job, "jobs")
    if name == "remoteok":
        job = F.struct(F.when(k % 17 != 0, k.cast("string")).alias("id"), F.when(k % 19 != 0, F.col("c_name")).alias("company"), title.alias("position"), place.alias("location"), F.when(k % 3 == 0, k).otherwise(0).alias("salary_min"), F.when(k % 2 == 0, k + 5000).alias("salary_max"), F.col("stamp").alias("date"))
        return payloads(j, job, None)
    line = F.concat_ws(" | ", F.col("c_name"), title, F.when(k % 3 != 0, F.lit("Remote, EU")), F.when(k % 2 == 0, F.concat(F.lit("$"), k, F.lit("k"))))
    body = F.when(k % 23 == 0, "Is this a question?").when(k % 29 == 0, F.lit(None).cast("string")).otherwise(F.concat(line, F.lit("<p>more &amp; more</p>")))
    return payloads(j, F.struct(k.alias("id"), F.lit("a").alias("author"), F.col("stamp").alias("created_at"), body.alias("text")), "children")


def parsed(spark, d, name: str):
    return boards.get(name).parse(boards.get(name).items(raw(spark, d, name)), companies(spark, d))


def _in_india(place: str) -> str:
    return f"(NOT regexp_matches(coalesce({place}, ''), '{_word(text.NOT_INDIA)}') AND regexp_matches(coalesce({place}, ''), '{_word(text.INDIA)}'))"


_ROLE = f"(NOT regexp_matches(coalesce(title, ''), '{_word(text.OTHER_ROLES)}') AND regexp_matches(coalesce(title, ''), '{_word(text.ROLE_TERMS)}'))"
_LEVER_PLACE = "CASE WHEN id % 2 = 0 THEN CASE WHEN place IS NULL THEN 'Berlin' ELSE place || '; Berlin' END ELSE place END"
_ASHBY_PLACE = "CASE WHEN id % 7 = 0 THEN CASE WHEN place IS NULL THEN 'Pune' ELSE place || '; Pune' END ELSE place END"
_NAMED = "trim(coalesce(title, '')) <> '' AND company IS NOT NULL"
_USABLE = {
    "greenhouse": f"{_NAMED} AND {_in_india('place')} AND {_ROLE}",
    "lever": f"{_NAMED} AND {_in_india(_LEVER_PLACE)} AND {_ROLE}",
    "ashby": f"{_NAMED} AND id % 11 <> 0 AND ({_in_india(_ASHBY_PLACE)} OR id % 13 = 0) AND {_ROLE}",
    "remoteok": "trim(coalesce(title, '')) <> '' AND id % 19 <> 0",
    "hackernews": "id % 23 <> 0 AND id % 29 <> 0",
}
#: Items that come at all: jobs with an id.
_THERE = {"remoteok": "id % 17 <> 0"}


def board(name: str, number: str, columns: str) -> None:
    """Registers the parse of a board's usable items against columns of SQL."""

    @query(f"{number}_{name}", f"WITH {_JOBS} SELECT {columns} FROM j WHERE {_THERE.get(name, 'true')} AND {_USABLE[name]}")
    def _(spark, d):
        s = boards.silver(parsed(spark, d, name))
        return s.select("source_id", "title", "company", "location", "is_remote", "description", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), *(["salary_raw"] if name in ("remoteok", "hackernews") else []))


_REMOTE = _word(["remote", "work\\s+from\\s+home", "wfh", "anywhere", "distributed", "telecommute"])
#: Places as they are stored: without words of remote work, and by their usual name.
_STORED = "CASE WHEN {0} = 'Remote - India' THEN 'India' WHEN {0} LIKE 'Remote - India; %' THEN 'India' || substr({0}, 15) ELSE {0} END"
board("greenhouse", "s5", f"source_id, trim(title) AS title, company, {_STORED.format('place')} AS location, regexp_matches(place, '{_REMOTE}') AS is_remote, c_name || ' & co' AS description, CASE WHEN id % 2 = 0 THEN CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) ELSE TIMESTAMP '2025-05-05' END AS posted_at")
board("lever", "s6", f"source_id, trim(title) AS title, company, {_STORED.format(_LEVER_PLACE)} AS location, id % 5 = 0 OR regexp_matches({_LEVER_PLACE}, '{_REMOTE}') AS is_remote, 'About us' || chr(10) || chr(10) || 'Skills' || chr(10) || chr(10) || c_name AS description, make_timestamp(id * 1000000) AS posted_at")
board("ashby", "s7", f"source_id, trim(title) AS title, company, {_STORED.format(_ASHBY_PLACE)} AS location, regexp_matches(coalesce({_ASHBY_PLACE}, ''), '{_REMOTE}') AS is_remote, c_name AS description, CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS posted_at")

_OK_PLACE = "CASE WHEN place = 'Remote - India' THEN 'India' ELSE place END"
_FIGURE = "format('${{:,}}', {0})"
board("remoteok", "s8", f"""CAST(id AS VARCHAR) AS source_id, trim(title) AS title, c_name AS company, {_OK_PLACE} AS location, true AS is_remote, '' AS description, CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS posted_at,
  CASE WHEN id % 6 = 0 THEN {_FIGURE.format('id')} || ' - ' || {_FIGURE.format('id + 5000')} WHEN id % 3 = 0 THEN {_FIGURE.format('id')} WHEN id % 2 = 0 THEN {_FIGURE.format('id + 5000')} END || ' per year' AS salary_raw""")

#: A comment without a title has its place, or its pay, where the title would be.
_PARTS = "list_filter([c_name, trim(title), CASE WHEN id % 3 <> 0 THEN 'Remote, EU' END, CASE WHEN id % 2 = 0 THEN '$' || id || 'k' END], lambda x: coalesce(x, '') <> '')"


@query("s9_hackernews", f"""WITH {_JOBS}, p AS (SELECT *, {_PARTS} AS p FROM j WHERE {_USABLE['hackernews']})
  SELECT CAST(id AS VARCHAR) AS source_id, p[2] AS title, p[1] AS company, CASE WHEN list_contains(p[3:], 'Remote, EU') THEN 'EU' END AS location, id % 3 <> 0 AS is_remote,
  regexp_replace(array_to_string(list_filter([c_name, title, CASE WHEN id % 3 <> 0 THEN 'Remote, EU' END, CASE WHEN id % 2 = 0 THEN '$' || id || 'k' END], lambda x: x IS NOT NULL), ' | '), ' +', ' ', 'g') AS line,
  CASE WHEN list_contains(p[3:], '$' || id || 'k') THEN '$' || id || 'k' END AS salary_raw FROM p WHERE len(p) >= 2""")
def _(spark, d):
    s = boards.silver(parsed(spark, d, "hackernews"))
    first = F.substring_index("description", "\n", 1)
    return s.select("source_id", "title", "company", "location", "is_remote", first.alias("line"), "salary_raw")


@query("p6_skipped_items", f"WITH {_JOBS}, p AS (SELECT *, {_PARTS} AS p FROM j) " + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS fetched, count(*) FILTER (NOT coalesce({u + (' AND len(p) >= 2' if n == 'hackernews' else '')}, false)) AS skipped FROM p WHERE {_THERE.get(n, 'true')}" for n, u in _USABLE.items()))
def _(spark, d):
    items = None
    for name in boards.SOURCES:
        own = boards.get(name).items(raw(spark, d, name))
        items = own if items is None else items.unionByName(own)
    return boards.skipped(boards.parsed(items, companies(spark, d)))


@query("p7_required_text", f"WITH {_JOBS} SELECT source_id, trim(title) AS title, company FROM j WHERE {_NAMED} AND {_in_india('place')} AND {_ROLE}")
def _(spark, d):
    return parsed(spark, d, "greenhouse").where("usable").select("source_id", "title", "company")


@query("s30_board_audit", f"""WITH {_JOBS} SELECT split_part(source_id, ':', 1) AS board, count(*) AS jobs_total, count(*) FILTER ({_in_india('place')}) AS jobs_in_india, count(*) FILTER (coalesce({_USABLE['greenhouse']}, false)) AS jobs_kept, 'ok' AS status FROM j GROUP BY 1
  UNION ALL SELECT 'gone', 0, 0, 0, 'failed'""")
def _(spark, d):
    failed = spark.createDataFrame([("gone", "failed")], "board string, status string")
    return boards.audit(parsed(spark, d, "greenhouse"), failed)


@query("s2_raw_items", f"WITH {_JOBS} SELECT 'greenhouse' AS source, source_id FROM j UNION ALL SELECT 'lever', source_id FROM j UNION ALL SELECT 'remoteok', CAST(id AS VARCHAR) FROM j WHERE id % 17 <> 0")
def _(spark, d):
    out = None
    for name in ("greenhouse", "lever", "remoteok"):
        own = boards.get(name).items(raw(spark, d, name)).select("source", "source_id")
        out = own if out is None else out.unionByName(own)
    return out


def bronze(spark, d):
    """Items of a board, stored by one run, as the write path has them."""
    items = boards.get("greenhouse").items(raw(spark, d, "greenhouse"))
    none = spark.createDataFrame([], runs.BRONZE)
    return runs.to_bronze(items, none, "r1", F.lit("2026-02-01").cast("timestamp"))


def stored(spark, d):
    """Postings that are there before a transform: of even ids, and some that no item stands for."""
    j = jobs(spark, d).where("id % 2 = 0")
    rows = j.select(F.lit("greenhouse").alias("source"), F.concat_ws(":", "slug", F.col("id").cast("string")).alias("source_id"))
    more = j.where("id % 50 = 0").select(F.lit("greenhouse").alias("source"), F.concat(F.lit("gone:"), F.col("id").cast("string")).alias("source_id"))
    new = boards.silver(parsed(spark, d, "greenhouse")).limit(0)
    kinds = dict(new.dtypes)
    rest = [F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in ("source", "source_id")]
    stamps = [F.lit("2026-01-01").cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at")]
    return rows.unionByName(more).select("source", "source_id", *rest, *stamps)


_OLD = "o AS (SELECT source_id FROM j WHERE id % 2 = 0 UNION ALL SELECT 'gone:' || id FROM j WHERE id % 50 = 0)"
_NOW = f"n AS (SELECT source_id, coalesce({_USABLE['greenhouse']}, false) AS usable FROM j)"


@query("g9_dry_run", f"""WITH {_JOBS}, {_OLD}, {_NOW}, a AS (SELECT CASE WHEN o.source_id IS NULL THEN CASE WHEN usable THEN 'inserted' END WHEN n.source_id IS NULL THEN 'untouched' WHEN usable THEN 'updated' ELSE 'pruned' END AS action FROM o FULL JOIN n ON o.source_id = n.source_id)
  SELECT action, count(*) AS postings FROM a WHERE action IS NOT NULL GROUP BY action""")
def _(spark, d):
    return runs.transform(bronze(spark, d), stored(spark, d), companies(spark, d), F.lit("2026-02-01").cast("timestamp"), prune=True)[1]


@query("j8_rejected", f"WITH {_JOBS}, {_OLD}, {_NOW} SELECT 'greenhouse' AS source, source_id FROM o WHERE source_id IN (SELECT source_id FROM n WHERE NOT usable)")
def _(spark, d):
    return runs.rejected(stored(spark, d), parsed(spark, d, "greenhouse")).select("source", "source_id")


@query("s22_bronze_append", f"""WITH {_JOBS} SELECT source_id, 'r2' AS run_id FROM j WHERE id % 3 = 0 OR id % 4 = 0""")
def _(spark, d):
    first = bronze(spark, d).where("cast(split(source_id, ':')[1] as long) % 3 <> 0")
    changed = F.when(F.split("source_id", ":")[1].cast("long") % 4 == 0, F.regexp_replace("payload", r"\}$", ',"x":1}')).otherwise(F.col("payload"))
    items = boards.get("greenhouse").items(raw(spark, d, "greenhouse")).withColumn("payload", changed)
    twice = items.unionByName(items.withColumn("payload", F.regexp_replace("payload", r"^\{", "{ ")))  # a batch that was sent twice
    return runs.to_bronze(twice, first, "r2", F.lit("2026-02-02").cast("timestamp")).select("source_id", "run_id")


@query("s12_bronze_latest", "SELECT event_type AS source, user_id AS source_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    return runs.bronze_scan(history_rows(spark, d)).select("source", "source_id", "seq")


@query("s12_bronze_of_run", "SELECT event_type AS source, user_id AS source_id, event_id AS seq FROM events WHERE day(ts) = 7 AND event_type = 'click'")
def _(spark, d):
    return runs.bronze_scan(history_rows(spark, d), "day7", "click").select("source", "source_id", "seq")


def history_rows(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("event_type").alias("source"), F.col("user_id").alias("source_id"), F.concat(F.lit("day"), F.dayofmonth("ts")).alias("run_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"))


@query("s11_silver_scan", f"WITH {_JOBS} SELECT id, source_id, company, is_remote FROM (SELECT id, source_id, c_name AS company, id % 3 = 0 AS is_remote, 's' || (id % 4) AS source FROM j) WHERE source = 's1'")
def _(spark, d):
    k = F.col("id")
    own = {"id": k, "source": F.concat(F.lit("s"), k % 4), "source_id": F.concat_ws(":", "slug", k.cast("string")), "company": F.col("c_name"), "is_remote": F.when(k % 3 == 0, True)}
    rows = jobs(spark, d).select(*[own.get(c, F.lit(None).cast("string")).alias(c) for c in runs.SILVER], F.lit(1).alias("more"))
    return runs.silver_scan(rows, "s1").select("id", "source_id", "company", "is_remote")


@query("j5_array_relation", "SELECT o_orderkey, CAST(i AS INT) AS position, CASE i WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority WHEN 3 THEN 'x' END AS a, CASE i WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey + 1 END AS b FROM orders, range(1, 4) r(i)")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.lit("x")).alias("a"), F.array("o_custkey", F.col("o_custkey") + 1).alias("b"))
    return history.relation(o, ["o_orderkey"], ["a", "b"])


@query("j9_rows_of_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    ids = t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return history.with_ids(t(spark, d, "customer"), ids, "c_custkey").select("c_custkey", "c_name")
