"""Queries ask their whole query set, all terms and all candidates."""

from pyspark.sql import functions as F

from tidemill.operators import topics as ops
from tidemill.plans import catalog, registry, topics  # noqa: F401


def test_query_set_grows(spark, sf_dir):
    asked = {r.query_id for r in catalog.asked(spark, sf_dir).collect()}
    every = {r.vec_id for r in registry.t(spark, sf_dir, "embeddings").collect()}
    assert asked == {i for i in every if i % 100 == 0}


def test_a_late_word_is_asked(spark, tmp_path):
    d, early = str(tmp_path), "a b c d e f g h"
    spark.createDataFrame([(0, early + " late")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "late"), (2, "other")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert [r.doc_id for r in catalog.keyword_hits(spark, d).collect()] == [1]


def test_both_lists_have_fifty(spark, sf_dir):
    for side in catalog.two_lists(spark, sf_dir):
        assert {r.n for r in side.groupBy("query_id").agg(F.max("rank").alias("n")).collect()} == {50}


def test_k_is_chosen_of_3_to_10_with_10_restarts(spark, sf_dir, monkeypatch):
    fitted, fit = [], ops.k_means

    def one(points, k, restarts=10, seed=42):
        fitted.append((k, restarts))
        return fit(points, k, 1, seed)

    monkeypatch.setattr(ops, "k_means", one)
    every = [(k, 10) for k in range(3, 11)]
    scores = registry.QUERIES["r12_choose_k"](spark, sf_dir).collect()
    assert fitted == every and [r.k for r in scores] == list(range(3, 11))
    fitted.clear()
    clusters = registry.QUERIES["r13_cluster_documents"](spark, sf_dir).count()
    assert fitted[:-1] == every and fitted[-1][1] == 10 and clusters <= fitted[-1][0]
