"""Queries of the write path: logs, chunks, pairs, pruning, the incremental index, and event folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import embed, runs
from tidemill.plans.catalog import _CLEANED, calls
from tidemill.plans.registry import query, r6, t
from tidemill.storage import fresh_path
from tidemill.streaming import events as folds

#: A run a user's day: it starts with the day's first event and ends with its last, if there are two.
_RUNS = """e AS (SELECT *, user_id * 31 + day(ts) AS run, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, day(ts)) AS c FROM events),
  r AS (SELECT run AS run_id, 's' || user_id % 7 AS source, max(CASE WHEN n = c AND c > 1 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END ELSE CASE WHEN c = 1 THEN 'running' END END) AS status,
    min(ts) AS started_at, max(ts) FILTER (n = c AND c > 1) AS finished_at, max(CASE WHEN n = c AND c > 1 THEN event_id END) AS fetched FROM e GROUP BY ALL)"""


def run_events(spark, d):
    from pyspark.sql import Window

    day = Window.partitionBy("user_id", F.dayofmonth("ts"))
    e = t(spark, d, "events").withColumn("n", F.row_number().over(day.orderBy("ts", "event_id"))).withColumn("c", F.count("*").over(day)).where("n = 1 or n = c")
    last = (F.col("n") == F.col("c")) & (F.col("c") > 1)
    status = F.when(~last, "running").when(F.col("event_type") == "error", "failed").otherwise("ok")
    none = F.lit(None).cast("long")
    return e.select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("run_id"), F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"), status.alias("status"), F.col("ts").alias("at"), F.when(last, F.col("event_id")).alias("fetched"), none.alias("inserted"), none.alias("updated"), none.alias("duplicates"), F.lit(None).cast("string").alias("error"))


@query("s28_run_log", f"WITH {_RUNS} SELECT run_id, source, status, started_at, finished_at, fetched FROM r")
def _(spark, d):
    return runs.current(run_events(spark, d)).select("run_id", "source", "status", "started_at", "finished_at", "fetched")


@query("w4_last_finished_run", f"WITH {_RUNS} SELECT source, run_id, status FROM r WHERE status <> 'running' QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1")
def _(spark, d):
    return runs.last_finished(runs.current(run_events(spark, d))).select("source", "run_id", "status")


@query("p13_finished_ok", f"WITH {_RUNS} SELECT source, max(finished_at) AS finished_at FROM r WHERE status = 'ok' GROUP BY source")
def _(spark, d):
    return runs.last_ok(runs.current(run_events(spark, d)))


@query("p13_calls_today", "SELECT count(*) AS calls, round(coalesce(sum(value), 0), 4) AS usd FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return runs.today(calls(spark, d), F.lit("2024-01-20 15:30:00").cast("timestamp_ntz")).select("calls", F.round("usd", 4).alias("usd"))


@query("s27_call_log", "SELECT event_type AS feature, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok, round(sum(value), 4) AS usd, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def _(spark, d):
    at = fresh_path(spark, "calls")
    c = calls(spark, d).withColumn("backend", F.col("backend").cast("string"))
    for half in (0, 1):  # two batches are appended
        runs.log_calls(c.where(F.col("event_id") % 2 == half), at)
    got = runs.store(spark, at, runs.CALL)
    return got.groupBy("feature").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.round(F.sum("cost_usd"), 4).alias("usd"), F.sum("prompt_tokens").alias("tokens"))


@query("g8_run_lifecycle", "SELECT 'run' || r_regionkey AS run_id, r_name AS source, CASE WHEN r_regionkey % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey * 10 AS BIGINT) ELSE 0 END AS fetched, CASE WHEN r_regionkey % 2 = 1 THEN 'no ' || r_name END AS error FROM region")
def _(spark, d):
    at = fresh_path(spark, "runs")

    def work(r):
        if r.r_regionkey % 2:
            raise RuntimeError(f"no {r.r_name}")
        return {"fetched": r.r_regionkey * 10}

    for r in t(spark, d, "region").collect():
        runs.lifecycle(spark, at, f"run{r.r_regionkey}", r.r_name, lambda r=r: work(r))
    return runs.current(runs.store(spark, at, runs.RUN)).select("run_id", "source", "status", "fetched", "error")


def index(spark, d):
    """Chunks of every third document, as an index that is behind."""
    none = spark.createDataFrame([], "posting_id long, strategy string, model string, chunk_index int, content string, embedding array<double>")
    return embed.new_chunks(postings(spark, d).where("posting_id % 3 = 0"), none, "whole", embed.hashing(64))


def postings(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("posting_id"), F.col("source").alias("title"), F.col("lang").alias("company"), F.lit(None).cast("string").alias("location"), F.col("text").alias("description"))


_CHUNK = f"substr(source || CASE WHEN coalesce(lang, '') <> '' THEN ' at ' || lang ELSE '' END || '. ' || {_CLEANED.format('text')}, 1, 1800)"


@query("r9_incremental_index", f"SELECT doc_id AS posting_id, 0 AS chunk_index, md5({_CHUNK}) AS content, 1.0::DOUBLE AS size FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    new = embed.new_chunks(postings(spark, d), index(spark, d), "whole", embed.hashing(64))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return r6(new.select("posting_id", "chunk_index", F.md5("content").alias("content"), size.alias("size")))


@query("s24_chunk_upsert", """SELECT vec_id // 4 AS posting_id, vec_id % 4 AS chunk_index, CASE WHEN vec_id % 8 = 0 THEN 'new' ELSE 'old' END AS content FROM embeddings UNION ALL SELECT 1000000 + vec_id, 0, 'new' FROM embeddings WHERE vec_id % 8 = 0""")
def _(spark, d):
    e = t(spark, d, "embeddings")
    rows = lambda key, n, content: (key.alias("posting_id"), F.lit("whole").alias("strategy"), F.lit("m").alias("model"), n.alias("chunk_index"), F.lit(content).alias("content"), F.col("embedding"))
    old = e.select(*rows(F.expr("vec_id div 4"), F.col("vec_id") % 4, "old"))
    some = e.where("vec_id % 8 = 0")
    new = some.select(*rows(F.expr("vec_id div 4"), F.col("vec_id") % 4, "new")).unionByName(some.select(*rows(F.col("vec_id") + 1000000, F.lit(0).cast("long"), "new")))
    return embed.merged(old, new).select("posting_id", "chunk_index", "content")


@query("s24_slice_rebuild", "SELECT label % 2 AS strategy, CASE WHEN label % 2 = 0 THEN 'new' ELSE 'old' END AS content, count(*) FILTER (label % 2 = 1 OR vec_id % 5 = 0) AS chunks FROM embeddings GROUP BY ALL")
def _(spark, d):
    e = t(spark, d, "embeddings").withColumn("strategy", F.col("label") % 2)
    old = e.select(F.col("vec_id").alias("posting_id"), "strategy", F.lit("m").alias("model"), F.lit(0).alias("chunk_index"), F.lit("old").alias("content"))
    new = old.where("strategy = 0 and posting_id % 5 = 0").withColumn("content", F.lit("new"))
    return embed.merged(old, new, rebuild=True).groupBy("strategy", "content").agg(F.count("*").alias("chunks"))


@query("s13_first_vectors", "SELECT doc_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM documents JOIN embeddings ON vec_id // 4 = doc_id WHERE vec_id % 4 = 0 AND label % 2 = 0")
def _(spark, d):
    e = t(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("doc_id"), (F.col("vec_id") % 4).alias("chunk_index"), F.when(F.col("label") % 2 == 0, "whole").otherwise("section").alias("strategy"), F.lit("m").alias("model"), "embedding")
    got = embed.first_vectors(t(spark, d, "documents").select("doc_id"), e, "whole", "m", "doc_id")
    return r6(got.select("doc_id", F.col("embedding")[0].cast("double").alias("first")))


@query("s25_recorded_pairs", """SELECT vec_id AS posting_id, vec_id + 1 AS duplicate_of, CASE WHEN vec_id % 3 = 0 THEN 'hash' ELSE 'embedding' END AS method, CAST(CASE WHEN vec_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS similarity FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 1 OR vec_id % 2 = 0 AND vec_id % 3 <> 0
  UNION ALL SELECT vec_id, vec_id + 1, 'hash', 0.5 FROM embeddings WHERE vec_id % 6 = 0 UNION ALL SELECT vec_id, vec_id + 1, 'embedding', 0.9 FROM embeddings WHERE vec_id % 6 = 0""")
def _(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("posting_id"), (F.col("vec_id") + 1).alias("duplicate_of"))
    stored = e.where("posting_id % 3 = 0").select("*", F.lit("hash").alias("method"), F.lit(0.5).alias("similarity"))
    new = e.where("posting_id % 2 = 0").withColumn("similarity", F.lit(0.9))
    once = runs.record_pairs(stored, new, "embedding")
    return runs.record_pairs(once, new.unionByName(new), "embedding")  # again changes nothing


@query("s26_cascade", """WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
  SELECT 'postings' AS part, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE (vec_id // 4) NOT IN (SELECT doc_id FROM g)
  UNION ALL SELECT 'pairs', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM g) AND vec_id + 3 NOT IN (SELECT doc_id FROM g)""")
def _(spark, d):
    docs, e = t(spark, d, "documents").select(F.col("doc_id").alias("posting_id")), t(spark, d, "embeddings")
    chunks = e.select(F.expr("vec_id div 4").alias("posting_id"), "vec_id")
    pairs = e.select(F.col("vec_id").alias("posting_id"), (F.col("vec_id") + 3).alias("duplicate_of"))
    left, out = runs.cascade(docs.where("posting_id % 5 = 0"), docs, chunks, pairs), None
    for name, part in zip(("postings", "chunks", "pairs"), left, strict=True):
        own = part.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("g2_cache_hits", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT user_id, event_id, n, false AS hit, us AS stored FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.n, us - stored <= 43200000000, CASE WHEN us - stored <= 43200000000 THEN stored ELSE us END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT user_id, event_id, hit FROM r""")
def _(spark, d):
    return folds.cache_hits(t(spark, d, "events"), "user_id", "ts", "event_id", 43200)


@query("g3_captured_changes", """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY day(ts) > 15, event_id) AS before FROM events)
  SELECT user_id, event_id FROM l WHERE day(ts) > 15 AND event_type IS DISTINCT FROM before""")
def _(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", (F.dayofmonth("ts") > 15).alias("new"))
    latest = e.where("not new").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return folds.changes(e.where("new"), latest, ["user_id"], "event_type", "event_id").select("user_id", "event_id")


_ROUTES = ("/search", "/jobs/{id}", "/jobs/{id}/skills", "/")
_PATHS = "CASE event_id % 6 WHEN 0 THEN '/search?q=a' WHEN 1 THEN '/jobs/' || event_id WHEN 2 THEN '/jobs/x.y/skills#top' WHEN 3 THEN '/' WHEN 4 THEN '/jobs/1/2' ELSE '/wp-admin' END"


@query("g7_routes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/search' WHEN 1 THEN '/jobs/{id}' WHEN 2 THEN '/jobs/{id}/skills' WHEN 3 THEN '/' ELSE 'unmatched' END AS route FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", folds.route(F.expr(_PATHS), _ROUTES).alias("route"))


@query("p9_long_texts", "SELECT doc_id FROM documents WHERE length(coalesce(text, '')) > 200")
def _(spark, d):
    return text.longer(t(spark, d, "documents"), "text", 200).select("doc_id")
