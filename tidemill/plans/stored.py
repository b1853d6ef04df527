"""Indexes over the shared tables, written once a session and read by every search after it, and what they skip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import english
from tidemill.operators import cells, index, search
from tidemill.plans.registry import query, t
from tidemill.storage import exists, fresh_path, kept, stamp

_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, d: str, name: str, what: str, make: Callable[[str], object]):
    """What make(path) wrote for a table's present files, as long as it stands; made when it is first asked for."""
    mark = (spark.sparkContext.applicationId, what, stamp(spark.read.parquet(f"{d}/{name}.parquet")))
    made = _MADE.get(mark)
    if made is None or not exists(spark, made.path):
        with kept():
            made = _MADE[mark] = make(fresh_path(spark, what))
    return made


def texts(spark: SparkSession, d: str) -> index.Index:
    """Words of the documents' texts, each of weight 1."""
    return once(spark, d, "documents", "words", lambda at: index.build(t(spark, d, "documents"), "doc_id", {"text": 1.0}, at))


def analysed(spark: SparkSession, d: str, title: bool = False) -> index.Index:
    """Stems of the documents' texts; with title, of their sources as titles and of their texts at a quarter."""
    fields = {"source": 1.0, "text": 0.25} if title else {"text": 1.0}
    return once(spark, d, "documents", "titled" if title else "stems", lambda at: index.build(t(spark, d, "documents"), "doc_id", fields, at, english.terms))


def vectors(spark: SparkSession, d: str) -> cells.VectorIndex:
    return once(spark, d, "embeddings", "vectors", lambda at: cells.build(t(spark, d, "embeddings"), "vec_id", at, keep=("label",)))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def near(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


#: The cell bounds cannot be had in SQL without the index; that every query skips something can.
@query("r3_skipped_blocks", """WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark)
  SELECT count(DISTINCT query_id) AS queries, true AS skipped FROM q JOIN w USING (term)""")
def _(spark, d):
    reads = index.find(texts(spark, d), benchmark(spark, d), 20).reads
    return reads.agg(F.count("*").alias("queries"), (F.sum("read") < F.sum("blocks")).alias("skipped"))


@query("k2_index_recall", "SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, count(*) FILTER (vec_id % 100 = 0) AS filled, true AS recalled FROM embeddings")
def _(spark, d):
    """Ten hits of each query from the index, and whether 95 of 100 are among the ten of an exact scan."""
    found = cells.find(vectors(spark, d), near(spark, d), 10, exclude_self=True)
    exact = search.vector(t(spark, d, "embeddings"), near(spark, d), "vec_id", 10, exclude_self=True).select("query_id", "vec_id", F.lit(1).alias("right"))
    per = found.join(exact, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("right").alias("right"))
    return per.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 10).alias("filled"), (F.sum("right") >= 0.95 * F.sum("n")).alias("recalled"))


@query("r4_index_filtered", "SELECT vec_id AS query_id, least(10, (SELECT count(*) FILTER (label = 3 AND vec_id <> q.vec_id) FROM embeddings)) AS hits FROM embeddings q WHERE vec_id % 100 = 0 AND (SELECT count(*) FROM embeddings WHERE label = 3) > 1")
def _(spark, d):
    """A filter that few rows pass: probing goes on until the limit is full, or all that pass are found."""
    found = cells.find(vectors(spark, d), near(spark, d), 10, F.col("label") == 3, exclude_self=True)
    return found.groupBy("query_id").agg(F.count("*").alias("hits"))
