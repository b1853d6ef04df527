"""Queries of label review, grades, decisions between configurations, and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import labels, measures, trends
from tidemill.plans.catalog import _SETS, calls, sets
from tidemill.plans.registry import query, r6, t


@query("u5_apply_decisions", f"""WITH {_SETS} SELECT user_id, array_to_string(CASE WHEN user_id % 3 = 0 THEN ['seen', 'view'] ELSE list_sort(list_intersect(a, b)) END, ',') AS label FROM s""")
def _(spark, d):
    s = sets(spark, d)
    made = s.where("user_id % 3 = 0").select("user_id", F.array(F.lit(" View"), F.lit("seen"), F.lit("view")).alias("terms"))
    return labels.decided(s, made, "user_id", "a", "b").select("user_id", F.array_join("label", ",").alias("label"))


_POOL = f"""{_SETS}, o AS (SELECT user_id, unnest(list_distinct(a || b)) AS term, a, b FROM s),
  p AS (SELECT user_id, term, CASE WHEN list_contains(a, term) AND list_contains(b, term) THEN 'both' WHEN list_contains(b, term) THEN 'rules' ELSE 'teacher' END AS origin,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5('7' || user_id || '|' || term), term) AS INT) AS position FROM o)"""


@query("u6_candidate_pool", f"WITH {_POOL} SELECT * FROM p")
def candidates(spark, d):
    return labels.pool(sets(spark, d), "user_id", "a", "b", 7)


@query("a25_provenance", f"""WITH {_POOL}, v AS (SELECT user_id, term, CASE WHEN user_id % 2 = 0 THEN 'kept' ELSE 'dropped' END AS verdict FROM p UNION ALL SELECT user_id, 'other', 'added' FROM s)
  SELECT coalesce(origin, CASE WHEN verdict = 'dropped' THEN 'teacher' ELSE 'human_only' END) AS origin, verdict, count(*) AS n FROM v LEFT JOIN p USING (user_id, term) GROUP BY ALL""")
def _(spark, d):
    offered = candidates(spark, d)
    own = offered.select("user_id", "term", F.when(F.col("user_id") % 2 == 0, "kept").otherwise("dropped").alias("verdict"))
    added = sets(spark, d).select("user_id", F.lit("other").alias("term"), F.lit("added").alias("verdict"))
    return labels.provenance(own.unionByName(added), offered, "user_id")


@query("a26_pass_agreement", f"""WITH {_POOL}, x AS (SELECT user_id % 2 = 0 AS a, length(term) % 2 = 0 OR user_id % 4 = 0 AS b FROM p), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL),
  e AS (SELECT sum(CAST(x.a <> y.b AS INT) * x.n * y.n) AS e FROM c x, c y), z AS (SELECT sum(CAST(a <> b AS INT) * n) AS o, sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c)
  SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round(1 - o * n / e, 6) AS kappa FROM z, e""")
def _(spark, d):
    offered = candidates(spark, d)
    pairs = labels.pass_pairs(offered.where("user_id % 2 = 0"), offered.where("length(term) % 2 = 0 or user_id % 4 = 0"), "user_id", offered)
    return r6(measures.kappa(pairs, "a", "b"))


@query("u9_merge_judgements", """SELECT doc_id % 9 AS query, doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE quality END AS grade FROM labels WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def _(spark, d):
    g = t(spark, d, "labels").select((F.col("doc_id") % 9).alias("query"), F.col("doc_id").alias("key"), F.col("quality").alias("grade"))
    return labels.merge_grades(g.where("key % 2 = 0"), g.where("key % 3 = 0").withColumn("grade", F.lit(0)), ["query", "key"])


@query("j16_work_list", "SELECT doc_id, lang FROM documents WHERE length(coalesce(text, '')) > 200 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs = t(spark, d, "documents").where(F.length(F.coalesce("text", F.lit(""))) > 200).select("doc_id", "lang")
    return labels.to_label(docs, t(spark, d, "labels"), ["doc_id"])


@query("t32_split_fingerprint", """WITH x AS (SELECT doc_id FROM labels ORDER BY md5('7' || doc_id), doc_id LIMIT 50)
  SELECT substr(sha256(string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR))), 1, 12) AS fingerprint, count(*) AS rows FROM x""")
def _(spark, d):
    return labels.fingerprint(labels.split(t(spark, d, "labels").select("doc_id"), "doc_id", 50, 7).where("part = 'test'"), "doc_id")


@query("d13_chat_rows", "WITH " + _SETS + """ SELECT user_id, md5('{"messages":[{"role":"system","content":"List skills."},{"role":"user","content":"Title: t\\n\\n' || user_id || '"},{"role":"assistant","content":"{\\"skills\\":[' ||
  array_to_string(list_transform(list_sort(a), lambda x: '\\"' || x || '\\"'), ',') || ']}"}]}') AS row FROM s""")
def _(spark, d):
    s = sets(spark, d)
    rows = labels.chat_rows(s, "List skills.", F.lit("t"), F.col("user_id").cast("string"), "a")
    user = F.regexp_extract("value", r"Title: t\\n\\n(\d+)", 1).cast("long")
    return rows.select(user.alias("user_id"), F.md5("value").alias("row"))


_CONFIGS = """c AS (SELECT 'label' || (label % 5) AS config, label % 5 AS position, avg(CAST((vec_id * 7919) % 101 AS DOUBLE)) / 100 AS ndcg, 100.0 * (label % 5) + 90 AS p95_ms FROM embeddings GROUP BY ALL)"""


def configs(spark, d):
    k = F.col("label") % 5
    e = t(spark, d, "embeddings").select(F.concat(F.lit("label"), k.cast("string")).alias("config"), k.alias("position"), ((F.col("vec_id") * 7919) % 101).cast("double").alias("v"))
    return e.groupBy("config", "position").agg((F.avg("v") / 100).alias("ndcg")).withColumn("p95_ms", 100.0 * F.col("position") + 90)


@query("a16_best_config", f"WITH {_CONFIGS} SELECT config, round(ndcg, 6) AS ndcg FROM c ORDER BY c.ndcg DESC, position LIMIT 1")
def _(spark, d):
    return r6(measures.best_config(configs(spark, d), "ndcg").select("config", "ndcg"))


@query("a31_decision_rule", f"""WITH {_CONFIGS}, p AS (SELECT c.*, c.config <> 'label0' AND c.ndcg - w.ndcg >= -0.5 AND c.p95_ms < 450 AS passing FROM c, (SELECT ndcg FROM c WHERE config = 'label0') w)
  SELECT config, round(ndcg, 6) AS ndcg, passing, coalesce(config = (SELECT arg_min(config, (-ndcg, p95_ms, config)) FROM p WHERE passing), false) AS chosen FROM p""")
def _(spark, d):
    return r6(measures.winner(configs(spark, d), "label0", "ndcg", -0.5, 450.0)).select("config", "ndcg", "passing", "chosen")


@query("a23_compare_versions", "WITH v AS (SELECT source AS metric, avg(n_chars) FILTER (doc_id % 2 = 0) AS l, avg(n_chars) FILTER (doc_id % 2 = 1) AS r FROM documents GROUP BY source) SELECT metric, round(l, 6) AS left, round(r, 6) AS right, round(r - l, 6) AS delta FROM v")
def _(spark, d):
    m = t(spark, d, "documents").groupBy((F.col("doc_id") % 2).cast("string").alias("version"), F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    return r6(measures.compare(m, "0", "1"))


@query("a22_chat_scores", """SELECT round(avg(turn % 3) / 2, 6) AS faithfulness, round(avg(conv_id % 3) / 2, 6) AS completeness, round(avg(CAST(conv_id % 4 <> 0 AS INT)), 6) AS citation_rate,
  round(avg(CAST(turn % 2 = 0 AS INT)) FILTER (conv_id % 5 = 0), 6) AS refusal_accuracy, round(sum(length(text) / 1000.0), 4) AS cost_usd FROM conversations""")
def _(spark, d):
    c, v = t(spark, d, "conversations"), F.col("conv_id")
    a = c.select((F.col("turn") % 3).alias("faithfulness"), (v % 3).alias("completeness"), (v % 4 != 0).alias("cited"), (v % 5 == 0).alias("must_refuse"), (F.col("turn") % 2 == 0).alias("refused"), (F.length("text") / 1000).alias("cost_usd"))
    s = measures.chat_scores(a)
    return r6(s.withColumn("cost_usd", F.round("cost_usd", 4)))


@query("g5_bucket_quantile", """WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(*) AS al FROM events, (SELECT unnest([10, 50, 100, 1000000]::DOUBLE[]) AS le) GROUP BY ALL),
  x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
  SELECT event_type, round(arg_min(low + (le - low) * (0.95 * al - below) / (n - below), le), 4) AS p95 FROM x WHERE n >= 0.95 * al GROUP BY event_type""")
def _(spark, d):
    h = trends.histogram(t(spark, d, "events"), ["event_type"], "value", (10.0, 50.0, 100.0, 1000000.0)).where("le < double('inf')")
    return measures.bucket_quantile(h, ["event_type"], 0.95).select("event_type", F.round("quantile", 4).alias("p95"))


@query("g6_sustained_alert", """WITH h AS (SELECT event_type, date_trunc('day', ts) AS d, round(avg(value), 6) AS v FROM events GROUP BY ALL),
  b AS (SELECT *, v > 10 AS bad, sum(CAST(v <= 10 AS INT)) OVER (PARTITION BY event_type ORDER BY d) AS run FROM h)
  SELECT event_type, count(*) FILTER (bad) AS broken, count(*) FILTER (bad AND d - since >= INTERVAL 2 DAYS) AS fired
  FROM (SELECT *, min(CASE WHEN bad THEN d END) OVER (PARTITION BY event_type, run) AS since FROM b) GROUP BY event_type""")
def _(spark, d):
    h = t(spark, d, "events").groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).agg(F.round(F.avg("value"), 6).alias("v"))
    f = measures.firing(h, ["event_type"], "at", F.col("v") > 10, 172800)
    return f.groupBy("event_type").agg(F.count_if(F.col("v") > 10).alias("broken"), F.count_if(F.col("firing")).alias("fired"))


@query("g6_spend_alert", "SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS spent, round(sum(value), 4) > 1 AS over FROM events GROUP BY 1")
def _(spark, d):
    return trends.overspent(calls(spark, d), 1.0)
