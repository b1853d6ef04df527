"""Queries of text functions over the shared documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import chunks, text
from tidemill.operators import embed, search, trends
from tidemill.plans.catalog import _CLEANED, _PACKED
from tidemill.plans.registry import query, r6, t

_CLEAN = _CLEANED.format("text")


@query("t4_normalise_for_hash", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.normalise_for_hash(F.col("text"))).alias("clean"))


@query("t6_payload_hash", """SELECT o_orderkey, md5('{"a":{"x":[1,' || (o_orderkey % 7) || '],"y":"' || o_orderstatus || '"},"b":' || o_orderkey || '}') AS hash FROM orders""")
def _(spark, d):
    payload = F.expr("""'{ "b": ' || o_orderkey || ', "a": {"y": "' || o_orderstatus || '", "x": [1, ' || (o_orderkey % 7) || ']}}'""")
    return t(spark, d, "orders").select("o_orderkey", text.payload_hash(payload).alias("hash"))


@query("t6_number_text", """SELECT o_orderkey, md5('{"n":' || o_orderkey || ',"p":' || CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR) || ',"whole":' || o_orderkey || '.0,"é":"ü\\n"}') AS hash FROM orders""")
def _(spark, d):
    payload = F.expr("""'{"whole": ' || o_orderkey || '.000, "p": ' || cast(o_totalprice as decimal(18,4)) || ', "\\\\u00e9": "ü\\\\n", "n": ' || o_orderkey || '}'""")
    return t(spark, d, "orders").select("o_orderkey", text.payload_hash(payload).alias("hash"))


_HEAD = "source || CASE WHEN coalesce(lang, '') <> '' THEN ' at ' || lang ELSE '' END || CASE doc_id % 3 WHEN 0 THEN ', Pune' ELSE '' END"


def headed():
    return text.header(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, " Pune ").when(F.col("doc_id") % 3 == 1, " "))


@query("t7_header", f"SELECT doc_id, {_HEAD} AS head FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", headed().alias("head"))


@query("t8_chunk_whole", f"SELECT doc_id, md5(substr({_HEAD} || '. ' || {_CLEAN}, 1, 1800)) AS chunk FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.chunk_whole(headed(), F.col("text"))).alias("chunk"))


@query("t10_chunk_strategies", f"WITH RECURSIVE {_PACKED} SELECT 'whole' AS strategy, count(*) AS chunks FROM documents UNION ALL SELECT 'section', CAST(sum(greatest(len(c), 1)) AS BIGINT) FROM m")
def _(spark, d):
    docs, out = t(spark, d, "documents"), None
    for name in chunks.STRATEGIES:
        part = docs.select(F.size(chunks.chunks(name, F.lit("h"), F.col("text"))).alias("n")).agg(F.lit(name).alias("strategy"), F.sum("n").alias("chunks"))
        out = part if out is None else out.unionByName(part)
    return out


@query("t12_posting_text", f"SELECT doc_id, md5({_CLEANED.format('source')} || '. ' || {_CLEANED.format('source')} || '. ' || {_CLEAN}) AS posting FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.posting_text(F.col("source"), F.col("text"))).alias("posting"))


@query("t20_render", f"SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Title: ' || source || chr(10) || chr(10) END || substr({_CLEAN}, 1, 1800)) AS prompt FROM documents")
def _(spark, d):
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))
    return t(spark, d, "documents").select("doc_id", F.md5(text.render(title, F.col("text"))).alias("prompt"))


@query("t21_tidy_list", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lower(source), coalesce(lang, 'en'), 'sql'], lambda x: x <> ''))), ',') AS tidy FROM documents")
def _(spark, d):
    raw = F.array(F.concat(F.lit(" "), F.upper("source")), F.coalesce("lang", F.lit("EN")), F.lit(""), F.lit("Sql "), F.col("source"), F.lit("  "))
    return t(spark, d, "documents").select("doc_id", F.array_join(text.tidy_list(raw), ",").alias("tidy"))


@query("t25_refusal", "SELECT conv_id, turn, conv_id % 3 = 0 OR NOT regexp_matches(text || CASE WHEN turn % 2 = 0 THEN ' [1]' ELSE '' END, '\\[\\d+\\]') AS refused FROM conversations")
def _(spark, d):
    answer = F.concat("text", F.when(F.col("turn") % 2 == 0, " [1]").otherwise(""))
    return t(spark, d, "conversations").select("conv_id", "turn", text.is_refusal(F.col("conv_id") % 3, text.citations(answer)).alias("refused"))


_ANSWERS = "CASE o_orderkey % 4 WHEN 0 THEN 'So:```json {\"a\": ' || o_orderkey || '} ```done' WHEN 1 THEN 'it is {\"a\": {\"b\": ' || o_orderkey || '}}, I think' WHEN 2 THEN ' plain ' || o_orderkey ELSE '{\"a\": -' || o_orderkey || '}' END"


@query("t26_extract_json", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{\"a\": ' || o_orderkey || '}' WHEN 1 THEN '{\"a\": {\"b\": ' || o_orderkey || '}}' WHEN 2 THEN 'plain ' || o_orderkey ELSE '{\"a\": -' || o_orderkey || '}' END AS found FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.extract_json(F.expr(_ANSWERS)).alias("found"))


@query("d12_structured_answer", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey <= 5000 THEN o_orderkey END AS score,
  CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey > 5000 THEN 'a is out of range' END WHEN 1 THEN 'a is missing' WHEN 2 THEN 'no JSON' ELSE 'a is out of range' END AS error FROM orders""")
def _(spark, d):
    s = text.structured(F.expr(_ANSWERS), "a BIGINT", {"a": (0, 5000)})
    return t(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.col("s.value.a").alias("score"), "s.error")


_SHOWN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\r\n|[\r\n]', ' ', 'g'), '\[[^\]]*(?:https?://|www\.)[^\]]*\]?', '', 'g'), '(?:https?://|www\.)\S+', '', 'g'), '\s+', ' ', 'g'))"


@query("t27_preview", f"SELECT doc_id, md5(substr({_SHOWN}, 1, 280) || CASE WHEN length({_SHOWN}) > 280 THEN '...' ELSE '' END) AS preview FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.preview(F.concat(F.lit("<b>A</b> | B | C\n"), F.col("text")))).alias("preview"))


@query("t28_markdown", r"SELECT doc_id, md5(regexp_replace(text, '([\\`*_\[\]<>#|~$])', '\\\1', 'g')) AS safe FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.escape_markdown(F.col("text"))).alias("safe"))


@query("t28_found_by", "SELECT doc_id, 'keyword #' || (doc_id % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' · vector #' || (doc_id % 5 + 1) ELSE '' END AS found_by FROM documents")
def _(spark, d):
    key, rank = F.lit("keyword"), (F.col("doc_id") % 9 + 1)
    ranks = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("vector"), F.col("doc_id") % 5 + 1, key, rank)).otherwise(F.create_map(key, rank))
    return t(spark, d, "documents").select("doc_id", text.found_by(ranks).alias("found_by"))


@query("t30_cluster_label", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ' / ' || coalesce(lang, '?') WHEN 1 THEN source || ' / sql' WHEN 2 THEN 'unlabelled' ELSE coalesce(lang, '?') || ' / ' || source END AS label FROM documents""")
def _(spark, d):
    k, lang = F.col("doc_id") % 4, F.coalesce("lang", F.lit("?"))
    none = F.array().cast("array<string>")
    terms = F.when(k == 0, F.array("source", F.concat("source", F.lit(" x")), lang, F.lit("more"))).when(k == 1, F.array("source", F.concat("source", F.lit("s")))).when(k == 2, none).otherwise(F.array(lang, F.concat(lang, F.lit("a")), F.col("source")))
    return t(spark, d, "documents").select("doc_id", text.label_of(terms, F.when(k == 2, none).otherwise(F.array(F.lit("sql"), F.lit("python")))).alias("label"))


_NOTES = "CASE doc_id % 5 WHEN 0 THEN 'find ' || source || ' | judged by A' WHEN 1 THEN 'judged by B' WHEN 2 THEN '' WHEN 3 THEN 'judged by A | judged by B' END"


@query("t33_merge_note", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'find ' || source || ' | judged by A | judged by B' WHEN 1 THEN 'judged by B' WHEN 2 THEN 'judged by B' WHEN 3 THEN 'judged by A | judged by B' ELSE 'judged by B' END AS merged, CASE doc_id % 5 WHEN 0 THEN 'find ' || source || ' | judged by B' ELSE 'judged by B' END AS replaced FROM documents")
def _(spark, d):
    note, own = F.expr(_NOTES), F.lit("judged by B")
    return t(spark, d, "documents").select("doc_id", text.merge_note(note, own).alias("merged"), text.merge_note(note, own, True).alias("replaced"))


#: The stretch of 30 words with most of the asked ones, by lists.
_ASKED = ("the", "der", "la", "token")
_HEADLINE = f"""w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT *, list_transform(w, lambda x: list_contains({list(_ASKED)}, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS f FROM w),
  h AS (SELECT *, list_filter(range(len(w)), lambda i: f[i + 1]) AS h FROM p),
  b AS (SELECT *, list_max(list_transform(h, lambda i: {{'n': len(list_filter(h, lambda j: j >= i AND j < i + 30)), 'at': -i}})) AS best FROM h),
  s AS (SELECT *, greatest(0, least(-best.at, len(w) - 10)) AS start FROM b)"""


@query("t29_headline", f"""WITH {_HEADLINE} SELECT doc_id, md5(CASE WHEN len(h) = 0 THEN array_to_string(w[1:10], ' ')
  ELSE array_to_string(list_transform(range(start, least(start + 30, len(w))), lambda i: CASE WHEN f[i + 1] THEN '<b>' || w[i + 1] || '</b>' ELSE w[i + 1] END), ' ') END) AS snippet FROM s""")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(search.headline(F.col("text"), F.array(*map(F.lit, _ASKED)))).alias("snippet"))


@query("d6_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return r6(e.join(nxt, "vec_id").select("vec_id", search.cosine(F.col("a"), F.col("b")).alias("similarity")))


_SCALED = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 5))"


@query("d7_unit_vector", f"WITH s AS (SELECT vec_id, {_SCALED} AS v FROM embeddings) SELECT vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 6) + 0 AS first, round(v[-1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 6) + 0 AS last FROM s")
def _(spark, d):
    v = search.unit(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)))
    own = t(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return own.select("vec_id", (F.round(F.col("v")[0], 6) + 0).alias("first"), (F.round(F.element_at("v", -1), 6) + 0).alias("last"))


@query("d8_vector_literal", "SELECT vec_id, md5('[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', CAST(x AS DOUBLE))), ',') || ']') AS literal, CAST(round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) * 1000000) AS BIGINT) AS total FROM embeddings")
def _(spark, d):
    e, v = t(spark, d, "embeddings"), search.quantised(F.col("embedding"))
    return e.select("vec_id", F.md5(search.literal(F.col("embedding"))).alias("literal"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) * 1_000_000).cast("long").alias("total"))


_PRICES = {"small": (0.02, 0.0), "large": (3.0, 15.0)}


@query("d10_tokens_and_dollars", """SELECT doc_id, length(text) // 4 AS tokens, round(CASE doc_id % 3 WHEN 0 THEN (length(text) // 4) * 0.02 WHEN 1 THEN (length(text) // 4) * 3.0 + 100 * 15.0 ELSE 0 END / 1000000, 9) AS usd FROM documents""")
def _(spark, d):
    model = F.when(F.col("doc_id") % 3 == 0, "small").when(F.col("doc_id") % 3 == 1, "large").otherwise("none")
    rows = t(spark, d, "documents").select("doc_id", embed.tokens(F.col("text")).alias("tokens"), model.alias("model"))
    return rows.select("doc_id", "tokens", F.round(embed.dollars(F.col("tokens"), F.lit(100), F.col("model"), _PRICES), 9).alias("usd"))


@query("a34_usage", """SELECT source, count(*) AS texts, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum((length(text) // 4) * 0.02) / 1000000, 6) AS usd, round(sum(doc_id % 700) / 1000, 6) AS seconds FROM documents GROUP BY source""")
def _(spark, d):
    calls = t(spark, d, "documents").select("source", embed.tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 700).alias("latency_ms"))
    calls = calls.withColumn("usd", embed.dollars(F.col("tokens"), F.lit(0), F.lit("small"), _PRICES))
    return r6(embed.usage(calls, ["source"]))


@query("d14_value_counts", "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(spark, d):
    return trends.value_counts(t(spark, d, "documents"), "source")


@query("d4_dates", "SELECT event_id, date_trunc('day', ts) AS day, ts - INTERVAL 7 DAYS AS week_before, ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAYS AS fresh FROM events")
def _(spark, d):
    ts = F.col("ts")
    fresh = ts >= F.lit("2024-01-20").cast("timestamp_ntz") - F.make_dt_interval(F.lit(5))
    return t(spark, d, "events").select("event_id", F.date_trunc("day", ts).cast("timestamp_ntz").alias("day"), (ts - F.make_dt_interval(F.lit(7))).alias("week_before"), fresh.alias("fresh"))


#: Words in 64 buckets by the first digits of their md5, scaled to length 1.
_BUCKETS = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
  b AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)"""


@query("r8_hashing_embedder", f"WITH {_BUCKETS} SELECT doc_id, CAST(bucket AS INT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b")
def _(spark, d):
    v = t(spark, d, "documents").select("doc_id", embed.hashing(64).encode(F.col("text")).alias("v"))
    return r6(v.select("doc_id", F.posexplode("v").alias("bucket", "weight")).where("weight > 0"))
