"""Queries of files: tables are written to the shared folder in a file's layout and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.registry import query, r6, t
from tidemill.sources import files
from tidemill.storage import fresh_path


@query("s14_jsonl_round_trip", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders")
def _(spark, d):
    at = fresh_path(spark, "jsonl")
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    files.write_jsonl(rows, at)
    return files.read_jsonl(spark, at, "o_orderkey long, o_orderstatus string, priority string")


@query("s15_pool_round_trip", "SELECT CAST(c_nationkey AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS position, c_name AS term FROM customer")
def _(spark, d):
    from pyspark.sql import Window

    at = fresh_path(spark, "pool")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    files.write_pool(t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), (F.row_number().over(w) - 1).alias("position"), F.col("c_name").alias("term")), at)
    return spark.read.schema("key string, terms array<string>").json(at).select("key", F.posexplode("terms").alias("position", "term"))


@query("s15_decisions", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS term, CASE n_nationkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'dropped' ELSE 'added' END AS verdict FROM nation")
def _(spark, d):
    at, k = fresh_path(spark, "decisions"), F.col("n_nationkey") % 3
    own = lambda n: F.when(k == n, F.array("n_name")).otherwise(F.array().cast("array<string>"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.struct(own(0).alias("keep"), own(1).alias("drop"), own(2).alias("added")).alias("v"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("value")).write.text(at)
    return files.read_decisions(spark, at)


_GRADED = "SELECT 'q' || n_nationkey AS query_id, CASE WHEN n_nationkey % 4 = 0 THEN 'rs:' || n_name ELSE n_name END AS source_id, CAST(n_nationkey % 3 AS INT) AS grade FROM nation"


def graded(spark, d):
    n, k = t(spark, d, "nation"), F.col("n_nationkey")
    queries = n.select(F.concat(F.lit("q"), k).alias("query_id"), F.concat(F.lit("jobs in: "), "n_name").alias("query"), F.lit("é").alias("note"), (k % 2 == 0).alias("verified"))
    grades = n.select(F.concat(F.lit("q"), k).alias("query_id"), F.lit("s").alias("source"), F.when(k % 4 == 0, F.concat(F.lit("rs:"), "n_name")).otherwise(F.col("n_name")).alias("source_id"), (k % 3).cast("int").alias("grade"))
    return queries, grades


@query("s16_graded_round_trip", _GRADED)
def _(spark, d):
    at = fresh_path(spark, "graded")
    files.write_graded(spark, at, *graded(spark, d))
    return files.read_graded(spark, at)[1].select("query_id", "source_id", "grade")


@query("p10_verified_only", "SELECT 'q' || n_nationkey AS query_id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0")
def _(spark, d):
    return files.verified_only(*graded(spark, d)).select("query_id")


@query("s17_vocabulary", "SELECT lower(n_name) AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS list FROM nation")
def _(spark, d):
    at, names = fresh_path(spark, "vocabulary"), [(r.n_nationkey, r.n_name) for r in t(spark, d, "nation").collect()]
    lists = {"accepted_tools": [n for k, n in names if k % 4 == 0], "accepted_more": [f" {n} " for k, n in names if k % 2 == 0], "rejected": [n for k, n in names if k % 2], "other": ["x"]}
    files.write_text(spark, at, "\n".join(f"{k}: {v}" for k, v in lists.items()))
    accepted, rejected = files.read_vocabulary(spark, at)
    return accepted.withColumn("list", F.lit("accepted")).unionByName(rejected.withColumn("list", F.lit("rejected")))


@query("s17_chat_cases", "SELECT 'c' || r_regionkey AS id, 'About ' || r_name || '?' AS question, r_regionkey % 2 = 0 AS must_refuse, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 2 END AS facts FROM region")
def _(spark, d):
    at = fresh_path(spark, "cases")
    rows = [f"- {{id: c{r.r_regionkey}, question: 'About {r.r_name}?', " + ("must_refuse: true}" if r.r_regionkey % 2 == 0 else "expected_facts: [a, 1]}") for r in t(spark, d, "region").collect()]
    files.write_text(spark, at, "questions:\n" + "\n".join(rows))
    return files.read_cases(spark, at).select("id", "question", "must_refuse", F.size("expected_facts").alias("facts"))


@query("s18_history_append", """SELECT metric, round(value, 4) AS value, run FROM (UNPIVOT (SELECT event_type, avg(value) AS mean, max(value) AS most, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type) ON mean, most, n INTO NAME metric VALUE value), (SELECT unnest([1, 2]) AS run)""")
def _(spark, d):
    at = fresh_path(spark, "history")
    e = t(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").cast("double").alias("n"))
    metrics = F.create_map(F.lit("mean"), "mean", F.lit("most"), "most", F.lit("n"), "n")
    for run in ("1", "2"):  # a second run is appended
        files.append_history(e.select(F.lit(f"2026-01-0{run}").alias("timestamp"), F.lit("retrieval").alias("suite"), F.col("event_type").alias("config"), F.lit("abc").alias("git_sha"), F.lit(24).alias("queries"), metrics.alias("metrics")), at)
    found = files.read_history(spark, at, suite="retrieval")
    return found.select("metric", "value", F.substring("timestamp", -1, 1).cast("int").alias("run"))


@query("k4_last_history", "SELECT event_type AS config, round(avg(value), 4) AS value FROM events GROUP BY event_type ORDER BY event_type DESC LIMIT 3")
def _(spark, d):
    at = fresh_path(spark, "history")
    e = t(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    files.append_history(e.select(F.lit("2026-01-01").alias("timestamp"), F.lit("s").alias("suite"), F.col("event_type").alias("config"), F.lit("abc").alias("git_sha"), F.lit(1).alias("queries"), F.create_map(F.lit("mean"), "mean").alias("metrics")), at)
    return files.read_history(spark, at, limit=3).select("config", "value")


@query("s19_baseline", "SELECT CASE WHEN event_type = 'click' THEN 'new' ELSE 'old' END AS suite, event_type AS config, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type UNION ALL SELECT 'new', 'x', 'mean', 0.5")
def _(spark, d):
    at = fresh_path(spark, "baseline")
    e = t(spark, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.avg("value").alias("value"))
    rows = e.select(F.when(F.col("config") == "click", "new").otherwise("old").alias("suite"), "config", F.lit("mean").alias("metric"), F.when(F.col("config") == "click", 9.0).otherwise(F.col("value")).alias("value"))
    files.write_baseline(spark, at, rows)
    own = e.where("config = 'click'").select(F.lit("new").alias("suite"), "config", F.lit("mean").alias("metric"), "value").unionByName(spark.createDataFrame([("new", "x", "mean", 0.5)], "suite string, config string, metric string, value double"))
    return r6(files.replace_suite(files.read_baseline(spark, at), own))


@query("s20_latest_prompts", "SELECT 'p' || r_regionkey AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'v10' ELSE 'v2' END AS version, r_name AS template FROM region")
def _(spark, d):
    r, k = t(spark, d, "region"), F.col("r_regionkey")
    versions = F.when(k % 2 == 0, F.array(F.lit("v2"), F.lit("v10"), F.lit("v9"))).otherwise(F.array(F.lit("v1"), F.lit("v2")))
    prompts = r.select(F.concat(F.lit("p"), k).alias("name"), F.explode(versions).alias("version"), F.col("r_name").alias("template"))
    return files.latest_prompts(prompts)


@query("s29_exposition", """SELECT 'orders_total{status="' || o_orderstatus || '",note="a\\\\b\\"c"} ' || count(*) AS line FROM orders GROUP BY o_orderstatus""".replace("\\\\", "\\\\"))
def _(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).withColumn("note", F.lit('a\\b"c'))
    return files.exposition(o, "orders_total", ["status", "note"], "n")


@query("s31_seed", "SELECT n_name AS name, CASE n_regionkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS provider, 's' || (n_nationkey % 20) AS slug, n_nationkey % 6 = 5 AS missing, count(*) OVER (PARTITION BY n_regionkey % 2, n_nationkey % 20) > 1 AS duplicate FROM nation WHERE n_regionkey < 4")
def _(spark, d):
    at, n = fresh_path(spark, "seed"), t(spark, d, "nation")
    provider = F.when(F.col("n_regionkey") >= 4, "workday").when(F.col("n_regionkey") % 2 == 0, "lever").otherwise("ashby")
    city = F.when(F.col("n_nationkey") % 6 == 5, "").otherwise("Pune")
    line = F.concat(F.lit('  { name: "'), "n_name", F.lit('", atsProvider: "'), provider, F.lit('", atsSlug: "s'), (F.col("n_nationkey") % 20).cast("string"), F.lit('", city: "'), city, F.lit('" },'))
    n.select(line.alias("value")).write.text(at)
    return files.read_seed(spark, at).select("name", "provider", "slug", "missing", "duplicate")


@query("s10_companies", "SELECT n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS provider, 'n' || n_nationkey AS slug, CASE WHEN n_nationkey % 3 = 0 THEN 'Pune' END AS city FROM nation")
def _(spark, d):
    at, rows = fresh_path(spark, "companies"), t(spark, d, "nation").collect()
    lines = [f"- {{name: '{r.n_name}', provider: {'lever' if r.n_nationkey % 2 == 0 else 'ashby'}, slug: n{r.n_nationkey}" + (", city: Pune}" if r.n_nationkey % 3 == 0 else "}") for r in rows]
    files.write_text(spark, at, "\n".join(lines))
    return files.read_companies(spark, at)
