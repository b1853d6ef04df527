"""Reranking by text, sources and prompts for questions, and matches of profiles.

Models stay outside: a scorer is any function of two columns, an answer comes in as a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import search

# What a model with a window reads of a document, header and all, and of its body's head; the gate.
DOCUMENT_CHARS, HEAD_CHARS = 2000, 1600
MIN_SIMILARITY = 0.30
DOCUMENTS = ("snippet", "head", "section")


def overlap(query: Column, document: Column) -> Column:
    """Share of the query's distinct terms that the document has; 0 for a query without terms."""
    q = F.array_distinct(search.terms(query))
    shared = F.size(F.array_intersect(q, search.terms(document)))
    return F.when(F.size(q) > 0, shared / F.size(q)).otherwise(0.0)


def document(parts: list[Column], body: Column, chars: int | None = None) -> Column:
    """Parts that aren't empty and the body, divided by full stops; whole, or cut to what a model reads (DOCUMENT_CHARS)."""
    whole = F.array_join(F.filter(F.array(*parts, body), lambda x: x != ""), ". ")
    return F.substring(whole, 1, chars) if chars else whole


def bodies(kind: str, hits: DataFrame, key: str, snippets: DataFrame | None = None, docs: DataFrame | None = None, chunks: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, key, body): what a scorer reads of each hit.

    snippet: snippets(query_id, key, body) of the first stage; head: the first HEAD_CHARS of docs(key,
    body); section: the chunk(key, content, embedding) nearest to the query's vector. Other kinds raise.
    """
    if kind == "snippet":
        return hits.select("query_id", key).join(snippets, ["query_id", key], "left").select("query_id", key, "body")
    if kind == "head":
        return hits.select("query_id", key).join(docs.select(key, F.substring("body", 1, HEAD_CHARS).alias("body")), key, "left").select("query_id", key, "body")
    if kind == "section":
        near = hits.select("query_id", key).join(chunks.select(key, "content", "embedding"), key).join(queries.select("query_id", "vector"), "query_id")
        best = F.max_by("content", F.struct(F.round(search.cosine(F.col("embedding"), F.col("vector")), 9), "content")).alias("body")
        return near.groupBy("query_id", key).agg(best)
    raise ValueError(f"unknown document {kind!r}; known: {', '.join(DOCUMENTS)}")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, key: str, limit: int = 20, scorer: Callable[[Column, Column], Column] = overlap, alpha: float | None = None) -> DataFrame:
    """hits(query_id, key, score, rank) ordered again by the scorer over queries(query_id, text) and docs(key, document).

    With alpha the score is alpha times the first stage's plus the rest of the scorer's, both scaled
    within the query. first_stage keeps the old rank. Hits whose document is missing score 0.
    """
    pool = hits.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(docs.select(key, F.col("document").alias("_d")), key, "left")
    pool = pool.select("query_id", key, F.col("rank").alias("first_stage"), F.col("score").alias("_first"), F.coalesce(scorer(F.col("_q"), F.coalesce("_d", F.lit(""))), F.lit(0.0)).alias("score"))
    if alpha is not None:
        pool = search.blend(pool.withColumnRenamed("score", "_second"), "_first", "_second", alpha).drop("_second")
    return search.ranked(pool.drop("_first"), "first_stage", limit)


def gated(hits: DataFrame, best: DataFrame, minimum: float = MIN_SIMILARITY) -> DataFrame:
    """hits of queries whose best(query_id, score) reaches the minimum; the others get nothing."""
    passed = best.groupBy("query_id").agg(F.max("score").alias("_b")).where(F.col("_b") >= minimum)
    return hits.join(passed.select("query_id"), "query_id", "left_semi")


def prompts(hits: DataFrame, docs: DataFrame, questions: DataFrame, key: str, limit: int = 8, template: str = "$sources\n\nQuestion: $question") -> DataFrame:
    """One row a question: its prompt, the keys of its sources in order, and their number.

    docs(key, title, company, location, remote, body). A question without sources has 0 and a null prompt.
    """
    own = hits.where(F.col("rank") <= limit).join(docs, key)
    block = text.source_block(F.col("rank"), F.col("title"), F.col("company"), F.col("location"), F.col("remote"), F.col("body"))
    per = own.select("query_id", F.struct("rank", F.col(key).alias("k"), block.alias("b")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("_s"))
    j = questions.select("query_id", F.col("text").alias("question")).join(per, "query_id", "left")
    filled = text.fill(F.lit(template), {"sources": F.array_join(F.transform("_s", lambda x: x["b"]), "\n\n"), "question": F.col("question")})
    return j.select("query_id", F.when(F.col("_s").isNotNull(), filled).alias("prompt"), F.transform("_s", lambda x: x["k"]).alias("sources"), F.coalesce(F.size("_s"), F.lit(0)).alias("n_sources")).withColumn("n_sources", F.greatest("n_sources", F.lit(0)))


def profile_query(skills: Column, body: Column) -> Column:
    """The first 15 skills, or else the first 400 characters."""
    return F.when(F.size(skills) > 0, F.array_join(F.slice(skills, 1, 15), " ")).otherwise(F.substring(F.coalesce(body, F.lit("")), 1, 400))


def matches(hits: DataFrame, profiles: DataFrame, docs: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Fit and gap of the hits of each profile: profiles(query_id, skills), docs(key, skills).

    fit is the share of the document's skills that the profile has, null where it names none;
    position orders a profile's matches by it, the best first.
    """
    j = hits.where(F.col("rank") <= limit).join(profiles.select("query_id", F.col("skills").alias("_has")), "query_id").join(docs.select(key, F.col("skills").alias("_wants")), key)
    fit = F.when(F.size("_wants") > 0, F.size(F.array_intersect("_wants", "_has")) / F.size("_wants"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(fit), "rank", key)
    j = j.withColumn("position", F.row_number().over(w))
    return j.select("query_id", key, "rank", "position", fit.alias("fit"), F.array_sort(F.array_intersect("_wants", "_has")).alias("has"), F.array_sort(F.array_except("_wants", "_has")).alias("gap"))


def assembled(prompted: DataFrame, answers: DataFrame, refusal: str = "I don't know.") -> DataFrame:
    """Answers with what they cite: prompted(query_id, sources) and answers(query_id, answer).

    cited are the keys of the sources that the answer names by number; numbers beyond them are left
    out and make it ungrounded. A question without sources, or an answer that cites nothing, is refused,
    and one without sources gets the refusal as its answer.
    """
    j = prompted.join(answers, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array()))
    said = F.when(F.size("sources") == 0, F.lit(refusal)).otherwise(F.coalesce("answer", F.lit(refusal)))
    j = j.withColumn("answer", said).withColumn("_n", text.citations(F.col("answer")))
    valid = F.filter("_n", lambda n: (n >= 1) & (n <= F.size("sources")))
    j = j.withColumn("_v", valid).withColumn("cited", F.transform("_v", lambda n: F.element_at("sources", n)))
    return j.select("query_id", "answer", "cited", text.is_refusal(F.size("sources"), F.col("_n")).alias("refused"), ((F.size("_n") > 0) & (F.size("_n") == F.size("_v"))).alias("grounded"))
