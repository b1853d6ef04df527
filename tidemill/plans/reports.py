"""Queries of reports, label review, splits and rank arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import labels, measures, search, topics, trends
from tidemill.plans.catalog import _HITS, _SETS, hits, sets
from tidemill.plans.registry import query, r6, t
from tidemill.plans.reviews import _POOL, candidates

_RECENT = "r AS (SELECT *, doc_id % 5 = 0 AS remote FROM documents WHERE doc_id % 7 = 0 OR TIMESTAMP '2024-01-31' - INTERVAL (doc_id % 120) DAYS >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAYS)"


@query("a11_summary", f"""WITH {_RECENT}, s AS (SELECT source, count(*) AS n FROM r WHERE source IS NOT NULL GROUP BY source),
  k AS (SELECT lang AS skill, count(*) AS n FROM r WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, skill LIMIT 2),
  c AS (SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, 'City not stated') AS city, count(*) AS n, avg(CAST(remote AS INT)) AS share FROM r GROUP BY 1 ORDER BY n DESC, city LIMIT 4)
  SELECT 90 AS window_days, (SELECT count(*) FROM r) AS postings, (SELECT round(avg(CAST(remote AS INT)), 3) FROM r) AS remote_share, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM s) AS sources,
    (SELECT string_agg(skill || ':' || n, ',' ORDER BY n DESC, skill) FROM k) AS top_skills, (SELECT string_agg(city || ':' || n, ',' ORDER BY n DESC, city) FROM c) AS top_regions""")
def _(spark, d):
    now, k = F.lit("2024-01-31").cast("timestamp_ntz"), F.col("doc_id")
    none = F.array().cast("array<string>")
    docs = t(spark, d, "documents").select(
        F.when(k % 7 != 0, now - F.make_dt_interval((k % 120).cast("int"))).alias("posted_at"), "source", (k % 5 == 0).alias("remote"),
        F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(none).alias("skills"), F.when((k % 3 > 0) & F.col("source").isNotNull(), F.array("source")).otherwise(none).alias("cities"),
    )
    s = trends.summary(docs, "posted_at", now, "source", "remote", "skills", "cities", 90, 2, 4)
    line = lambda c, name, n: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[name], x[n].cast("string"))), ",")
    return s.select("window_days", "postings", "remote_share", line(F.array_sort(F.map_entries("sources")), "key", "value").alias("sources"), line(F.col("top_skills"), "skill", "postings").alias("top_skills"), line(F.col("top_regions"), "city", "postings").alias("top_regions"))


@query("a11_remote_share", "SELECT round(avg(CAST(toxic = 1 AS INT)), 6) AS remote_share FROM labels")
def _(spark, d):
    return r6(trends.remote_share(t(spark, d, "labels").withColumn("remote", F.col("toxic") == 1), "remote"))


@query("a18_micro_f1", f"WITH {_SETS} SELECT round(2.0 * sum(len(list_intersect(a, b))) / (sum(len(a)) + sum(len(b))), 6) AS micro_f1, CAST(0 AS DOUBLE) AS nothing FROM s")
def _(spark, d):
    s = sets(spark, d).withColumn("none", F.array().cast("array<string>"))
    return r6(measures.micro_f1(s, "a", "b").withColumn("nothing", measures.micro_f1(s, "a", "none").scalar()))


@query("a20_confusion", "WITH c AS (SELECT label % 3 AS a, (label * 7 + vec_id % 2) % 3 AS b, count(*) AS n FROM embeddings GROUP BY ALL) SELECT CAST(x AS INT) AS a, CAST(y AS INT) AS b, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2]) AS x) CROSS JOIN (SELECT unnest([0, 1, 2]) AS y) LEFT JOIN c ON a = x AND b = y")
def _(spark, d):
    e = t(spark, d, "embeddings").select((F.col("label") % 3).alias("a"), ((F.col("label") * 7 + F.col("vec_id") % 2) % 3).alias("b"))
    return measures.confusion(e, "a", "b")


def _kappa(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS dimension, CAST(o.n AS BIGINT) AS n, round(o.same / o.n, 6) AS agreement, round(1 - (o.n - o.same) * o.n / e.e, 6) AS kappa FROM
  (SELECT count(*) AS n, count(*) FILTER ({a} = {b}) AS same FROM x) o, (SELECT sum(CAST(p.v <> q.v AS INT) * p.n * q.n) AS e FROM (SELECT {a} AS v, count(*) AS n FROM x GROUP BY 1) p, (SELECT {b} AS v, count(*) AS n FROM x GROUP BY 1) q) e"""


@query("a21_calibration", f"""WITH x AS (SELECT turn % 3 AS f1, (turn + conv_id % 2) % 3 AS f2, conv_id % 3 AS c1, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE conv_id % 3 END AS c2 FROM conversations), k AS ({_kappa('faithfulness', 'f1', 'f2')} UNION ALL {_kappa('completeness', 'c1', 'c2')})
  SELECT *, (SELECT max(n >= 20 AND kappa >= 0.4) FROM k WHERE dimension = 'completeness') AS trustworthy FROM k""")
def _(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    x = t(spark, d, "conversations").select((turn % 3).alias("f1"), ((turn + conv % 2) % 3).alias("f2"), (conv % 3).alias("c1"), F.when(conv % 5 == 0, 0).otherwise(conv % 3).alias("c2"))
    return r6(measures.calibration(x, {"faithfulness": ("f1", "f2"), "completeness": ("c1", "c2")}, "completeness"))


@query("a27_review_summary", f"""WITH {_SETS}, z AS (SELECT user_id, len(a) - len(list_intersect(a, b)) AS t, len(b) - len(list_intersect(a, b)) AS r FROM s)
  SELECT count(*) AS examples, count(*) FILTER (user_id % 4 = 0) AS verified, count(*) FILTER (t + r = 0) AS agreed, count(*) FILTER (t + r > 0) AS disputed, CAST(sum(t) AS BIGINT) AS teacher_only_mentions, CAST(sum(r) AS BIGINT) AS rules_only_mentions FROM z""")
def _(spark, d):
    return labels.review_summary(sets(spark, d), "a", "b", F.col("user_id") % 4 == 0)


@query("a27_adjudication_summary", f"""WITH {_SETS}, x AS (SELECT *, list_filter(a, lambda v: NOT list_contains(b, v)) AS own FROM s), y AS (SELECT *, list_distinct(b || list_intersect(a, b) || list_filter(own, lambda v: v = 'click')) AS label FROM x)
  SELECT count(*) AS examples, round(avg(len(label)), 2) AS mean_labels, CAST(sum(len(list_filter(label, lambda v: v NOT IN ('view', 'purchase')))) AS BIGINT) AS accepted_off_taxonomy,
    CAST(sum(len(list_filter(own, lambda v: v IN ('view', 'purchase')))) AS BIGINT) AS rejected_invented, CAST(sum(len(list_filter(own, lambda v: v NOT IN ('view', 'purchase', 'click')))) AS BIGINT) AS rejected_not_in_text FROM y""")
def _(spark, d):
    lit = lambda *x: F.array(*map(F.lit, x))
    taxonomy = lit("view", "purchase")
    s = sets(spark, d).withColumn("label", labels.adjudicated(F.col("a"), F.col("b"), taxonomy, lit("click"), F.lit("a click here")))
    return labels.adjudication_summary(s, "a", "label", "b", taxonomy)


@query("a32_cluster_summary", """WITH x AS (SELECT doc_id % 4 AS cluster, source, lang, (doc_id % 8) * 0.125 AS w FROM documents), p AS (SELECT cluster, source AS term, sum(w) AS s FROM x WHERE source IS NOT NULL GROUP BY ALL),
  q AS (SELECT cluster, lang AS skill, count(*) AS s FROM x WHERE lang IS NOT NULL GROUP BY ALL),
  tt AS (SELECT cluster, list(term ORDER BY s DESC, term) AS l FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, term) <= 10) GROUP BY cluster),
  ts AS (SELECT cluster, list(skill ORDER BY s DESC, skill) AS l FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, skill) <= 8) GROUP BY cluster)
  SELECT cluster, (SELECT count(*) FROM x y WHERE y.cluster = tt.cluster) AS postings, array_to_string(tt.l, ',') AS top_terms, array_to_string(ts.l, ',') AS top_skills,
    tt.l[1] || ' / ' || coalesce(list_filter(tt.l[2:], lambda v: NOT contains(v, tt.l[1]) AND NOT contains(tt.l[1], v))[1], ts.l[1]) AS label FROM tt JOIN ts USING (cluster)""")
def _(spark, d):
    docs = t(spark, d, "documents")
    clusters = docs.select("doc_id", (F.col("doc_id") % 4).alias("cluster"))
    terms = docs.where("source is not null").select("doc_id", F.col("source").alias("term"), ((F.col("doc_id") % 8) * 0.125).alias("weight"))
    skills = docs.where("lang is not null").select("doc_id", F.col("lang").alias("skill"))
    s = topics.describe(clusters, terms, skills, "doc_id")
    return s.select("cluster", "postings", F.array_join("top_terms", ",").alias("top_terms"), F.array_join("top_skills", ",").alias("top_skills"), "label")


@query("j14_graded_pairs", "SELECT a.doc_id, a.quality AS a, b.toxic AS b FROM labels a JOIN labels b USING (doc_id) WHERE a.doc_id % 3 <> 0 AND b.doc_id % 2 = 0")
def _(spark, d):
    rows = t(spark, d, "labels")
    one = rows.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("grade"))
    return measures.paired(one, rows.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("grade")), ["doc_id"])


@query("j15_overlaid_labels", "SELECT d.source, d.doc_id, quality AS label FROM documents d JOIN labels USING (doc_id) WHERE doc_id % 9 <> 0")
def _(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", F.lit(9).alias("label"))
    given = t(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.without(labels.overlay(docs, given, ["doc_id"]), docs.where("doc_id % 9 = 0"), ["doc_id"]).select("source", "doc_id", "label")


@query("j17_provenance_join", f"WITH {_POOL} SELECT s.user_id, coalesce(origin, 'human_only') AS origin, count(*) AS n FROM (SELECT user_id, 'click' AS term FROM s) s LEFT JOIN p USING (user_id, term) GROUP BY ALL")
def _(spark, d):
    kept = sets(spark, d).select("user_id", F.lit("click").alias("term"), F.lit("kept").alias("verdict"))
    return labels.provenance(kept, candidates(spark, d), "user_id", by=["user_id"]).select("user_id", "origin", "n")


@query("u2_disagreements", f"WITH {_SETS} SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(a || b), lambda x: list_contains(a, x) <> list_contains(b, x))), ',') AS differing FROM s")
def _(spark, d):
    return sets(spark, d).select("user_id", F.array_join(labels.disagreement(F.col("a"), F.col("b")), ",").alias("differing"))


@query("u7_gold", f"""WITH {_SETS}, x AS (SELECT user_id, list_distinct(a || b) AS o, a AS k, CASE WHEN user_id % 5 = 0 THEN [] ELSE list_filter(b, lambda v: NOT list_contains(a, v)) END AS d FROM s)
  SELECT user_id, array_to_string(list_sort(list_distinct(k || ['extra'])), ',') AS label, len(list_filter(o, lambda v: NOT list_contains(k, v) AND NOT list_contains(d, v))) = 0 AS valid FROM x""")
def _(spark, d):
    none = F.array().cast("array<string>")
    s = sets(spark, d).select("user_id", F.array_union("a", "b").alias("o"), F.col("a").alias("k"), F.when(F.col("user_id") % 5 == 0, none).otherwise(F.array_except("b", "a")).alias("x"), F.array(F.lit("extra")).alias("n"))
    return labels.gold(s, "o", "k", "x", "n").select("user_id", F.array_join("label", ",").alias("label"), "valid")


@query("u8_union_of_lists", f"WITH {_HITS} SELECT query_id, vec_id, CASE WHEN rank <= 5 THEN 'near' ELSE 'far' END AS list FROM v WHERE rank <= 10")
def _(spark, d):
    h = hits(spark, d).select("query_id", "vec_id", "rank")
    lists = {"near": h.where("rank <= 5"), "far": h.where("rank > 5")}
    return search.pooled(lists, "vec_id").select("query_id", "vec_id", F.col("found_by")[0].alias("list"))


@query("w5_ranks", "SELECT user_id AS query_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events")
def _(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"))
    return search.ranked(e, "event_id").select("query_id", "event_id", "rank")


@query("w6_ideal_gain", "WITH g AS (SELECT doc_id % 40 AS query_id, quality + toxic AS grade, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY quality + toxic DESC, doc_id) AS pos FROM labels) SELECT query_id, count(*) FILTER (grade > 0) AS relevant, round(sum(CASE WHEN pos <= 5 THEN grade / log2(pos + 1) ELSE 0 END), 6) AS ideal_5 FROM g GROUP BY query_id")
def _(spark, d):
    g = t(spark, d, "labels").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("key"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return r6(measures.ideal(g, (5,)))


@query("w7_scaled_scores", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS score FROM events WINDOW w AS (PARTITION BY user_id)")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("query_id"), F.col("value").alias("a"), F.lit(1.0).alias("b"))
    return r6(search.blend(e, "a", "b", 1.0).select("event_id", "score"))


@query("w8_running_stop", "WITH b AS (SELECT o_custkey AS board, count(*) AS usable FROM orders GROUP BY 1) SELECT board, usable FROM b QUALIFY coalesce(sum(usable) OVER (ORDER BY board ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200")
def _(spark, d):
    from tidemill.sources import boards

    return boards.until_enough(t(spark, d, "orders").groupBy(F.col("o_custkey").alias("board")).agg(F.count("*").alias("usable")), 200, "board")


@query("d9_gains", "SELECT event_id, round(1 / log2(n + 1), 6) AS discount, round(2.0 * n * (n + 1) / (2 * n + 1), 6) AS harmonic FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    n = F.col("n")
    return r6(e.select("event_id", measures.discount(n).alias("discount"), measures.harmonic(n.cast("double"), n + 1.0).alias("harmonic")))


@query("x3_hold_out", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9' || doc_id), doc_id) AS n, count(*) OVER () AS c FROM labels) SELECT doc_id, CASE WHEN n <= greatest(1, CAST(floor(c * 0.1) AS BIGINT)) THEN 'test' ELSE 'train' END AS part FROM h")
def _(spark, d):
    return labels.hold_out(t(spark, d, "labels").select("doc_id"), "doc_id", 0.1, 9)


@query("x4_second_pass", "SELECT doc_id FROM labels ORDER BY md5('11' || doc_id), doc_id LIMIT 20")
def _(spark, d):
    return labels.second_pass(t(spark, d, "labels"), "doc_id", 20, 11).select("doc_id")


@query("p15_row_guards", "SELECT 'regions' AS what, least(count(*), 20) AS rows, count(*) >= 20 AS enough FROM region UNION ALL SELECT 'nations', least(count(*), 20), count(*) >= 20 FROM nation UNION ALL SELECT 'orders', least(count(*), 20), count(*) >= 20 FROM orders")
def _(spark, d):
    out = None
    for what, name in (("regions", "region"), ("nations", "nation"), ("orders", "orders")):
        part = topics.row_guard(t(spark, d, name), 20, what)
        out = part if out is None else out.unionByName(part)
    return out
