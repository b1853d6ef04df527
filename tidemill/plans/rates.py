"""Queries of sliding rates and shares, and of changes to several tables at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import commits, history
from tidemill.plans.registry import query, r6, t
from tidemill.storage import fresh_path
from tidemill.streaming import rates

#: A status for each event, and a label that is made of users.
_STATUS = "CASE WHEN event_type <> 'error' THEN 200 WHEN value < 50 THEN 404 ELSE 500 END"
#: Windows of five minutes that begin every 15 seconds: an event lies in the twenty that begin up to it.
_IN = "unnest(range(0, 20)) AS k, epoch_us(ts) // 15000000 AS pane"


@query("g5_sliding_rates", f"""WITH e AS (SELECT 'route' || (user_id % 3) AS route, {_STATUS} AS status, {_IN} FROM events)
  SELECT make_timestamp((pane - k) * 15000000) AS start, route, count(*) AS total, round(count(*) / 300, 6) AS rate, round(count(*) FILTER (status = 404) / count(*), 6) AS share_client, round(count(*) FILTER (status = 500) / count(*), 6) AS share_server
  FROM e GROUP BY ALL""")
def _(spark, d):
    e = t(spark, d, "events").withColumn("route", F.concat(F.lit("route"), F.col("user_id") % 3)).withColumn("status", F.expr(_STATUS))
    kinds = {"client": F.col("status").between(400, 499), "server": F.col("status") >= 500}
    got = rates.sliding(rates.panes(e, "ts", ["route"], kinds), ["route"])
    return r6(got.select(F.col("start").cast("timestamp_ntz").alias("start"), "route", "total", "rate", "share_client", "share_server"))


@query("g5_counter_rates", """WITH l AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, value) AS before FROM events),
  i AS (SELECT event_type, epoch_us(ts) // 15000000 AS pane, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS up FROM l),
  w AS (SELECT event_type, up, pane - unnest(range(0, 20)) AS pane FROM i)
  SELECT make_timestamp(pane * 15000000) AS start, event_type, round(sum(up), 4) AS increase FROM w GROUP BY ALL""")
def _(spark, d):
    got = rates.counter_rates(t(spark, d, "events"), ["user_id", "event_type"], ["event_type"], "ts", "value")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("increase", 4).alias("increase"))


@query("g9_changes_at_once", """WITH p AS (SELECT doc_id, md5(text) AS h FROM documents), g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM p WHERE h IS NOT NULL QUALIFY count(*) OVER (PARTITION BY h) > 1)
  SELECT 'postings' AS name, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM p WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'chunks', count(*), CAST(sum(doc_id) AS BIGINT) FROM p, range(0, 2) WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'pairs', count(*), CAST(sum(doc_id) AS BIGINT) FROM g WHERE doc_id <> first AND doc_id % 5 <> 0 AND first % 5 <> 0""")
def _(spark, d):
    """Three tables are written as one, rows are deleted from all, and a dry run and a change that fails leave them alone."""
    store, docs = commits.Store(spark, fresh_path(spark, "store")), t(spark, d, "documents")
    with store.change() as c:
        c.write("postings", docs.select("doc_id", F.md5("text").alias("h")))
        c.write("chunks", docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")))
        same = history.hash_groups(c.read("postings"), "doc_id", "h").where("doc_id <> class_id")
        c.write("pairs", same.select("doc_id", F.col("class_id").alias("first")))

    def pruned(c, keep):
        c.write("postings", c.read("postings").where(keep.format("doc_id")))
        alive = c.read("postings").select("doc_id")
        c.write("chunks", c.read("chunks").join(alive, "doc_id", "left_semi"))
        c.write("pairs", c.read("pairs").join(alive, "doc_id", "left_semi").join(alive.withColumnRenamed("doc_id", "first"), "first", "left_semi"))

    with store.change() as c:
        pruned(c, "{0} % 5 <> 0")
    with store.change(dry=True) as c:
        pruned(c, "{0} % 2 = 0")
    try:
        with store.change() as c:
            c.write("postings", c.read("postings").limit(0))
            raise InterruptedError
    except InterruptedError:
        pass
    out = None
    for name in ("postings", "chunks", "pairs"):
        own = store.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
        out = own if out is None else out.unionByName(own)
    return out
