"""Queries of the extension points: the table function, the estimator and the reranking grid."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemill.functions import tables
from tidemill.operators import answers, encoder, experiments
from tidemill.plans.catalog import _HITS, _SKILLS, hits
from tidemill.plans.registry import query, r6, t

@query("t10_lateral_chunks", """SELECT doc_id, count(*) AS chunks, CAST(max(chunk_index) AS INT) AS last, md5(string_agg(content, '|' ORDER BY chunk_index)) AS content FROM (
  SELECT doc_id, 0 AS chunk_index, 'head. ' || substr(o, 1, 100) AS content FROM (SELECT doc_id, coalesce(source, '') || ' ' || doc_id AS o FROM documents)) GROUP BY doc_id""")
def _(spark, d):
    tables.register(spark)
    t(spark, d, "documents").createOrReplaceTempView("postings_to_chunk")
    rows = spark.sql("SELECT doc_id, c.* FROM postings_to_chunk, LATERAL chunks('section', 'head', source || ' ' || doc_id) c")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "|")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last"), F.md5(listed).alias("content"))


#: Documents in their usual settings name few skills, so a spelling is added to each.
@query("r11_skill_features", f"SELECT doc_id, count(DISTINCT skill) AS features FROM documents LEFT JOIN ({_SKILLS}) USING (doc_id) GROUP BY doc_id")
def _(spark, d):
    from tidemill.plans.catalog import _MENTION, TAXONOMY

    docs = t(spark, d, "documents").select("doc_id", F.expr(_MENTION.replace("doc_id // ", "doc_id div ")).alias("text"))
    model = encoder.SkillEncoder(skills=list(TAXONOMY), spellings=json.dumps(TAXONOMY)).fit(docs)
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x)
    return model.transform(docs).select("doc_id", ones.cast("long").alias("features"))


_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_KINDS = {"snippet": "source || ' ' || coalesce(lang, '')", "head": "substr(text, 1, 400)", "section": "substr(text, 401, 400)"}


def _grid_sql() -> str:
    """Each setting as a query over the pool of the first 50 hits."""
    out = []
    for s in experiments.GRID:
        if s.model is None:
            out.append(f"SELECT '{s.name}' AS config, query_id, vec_id, rank AS own FROM p WHERE rank <= 10")
            continue
        words = f"list_filter(regexp_split_to_array(coalesce({s.document}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')[1:{s.max_length}]"
        doc = f"array_to_string({words}, ' ')"
        own = _TERMS.format(doc)
        second = f"CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_intersect(asked, {own})) / len(asked) END" if s.model == "base" else f"1.0::DOUBLE / (1 + abs(length({doc}) - length(asked_text)))"
        score = "s"
        if s.alpha is not None:
            scaled = "CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0.0 END"
            score = f"{s.alpha}::DOUBLE * {scaled.format('score')} + {1 - s.alpha}::DOUBLE * {scaled.format('s')}"
        out.append(f"""SELECT '{s.name}', query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, first) AS own FROM (
          SELECT query_id, vec_id, rank AS first, {score} AS x FROM (SELECT *, {second} AS s FROM p WHERE rank <= {s.candidates}) {"WINDOW w AS (PARTITION BY query_id)" if s.alpha is not None else ""}) QUALIFY own <= 10""")
    return " UNION ALL ".join(f"({q})" for q in out)


@query("r17_rerank_grid", f"""WITH {_HITS}, p AS (SELECT v.query_id, v.vec_id, v.score, v.rank, q.text AS asked_text, list_distinct({_TERMS.format('q.text')}) AS asked, {", ".join(f"(SELECT {e} FROM documents x WHERE x.doc_id = v.vec_id) AS {k}" for k, e in _KINDS.items())}
  FROM v JOIN documents q ON q.doc_id = v.query_id) SELECT config, count(*) AS n, CAST(sum(own * vec_id) AS BIGINT) AS ranks FROM ({_grid_sql()}) GROUP BY config""")
def _(spark, d):
    docs = t(spark, d, "documents")
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    first = r6(hits(spark, d, 50)).join(queries.select("query_id"), "query_id")
    kinds = docs.select(F.col("doc_id").alias("vec_id"), *[F.expr(e).alias(k) for k, e in _KINDS.items()])
    models = {"base": answers.overlap, "small": lambda q, x: 1.0 / (1 + F.abs(F.length(x) - F.length(q)))}
    got = experiments.run(first, queries.where("text is not null"), kinds, "vec_id", models, 10)
    return got.groupBy("config").agg(F.count("*").alias("n"), F.sum(F.col("rank") * F.col("vec_id")).alias("ranks"))
