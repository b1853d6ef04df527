"""The stored inverted index against a search of the whole table, and what it does not read."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import english
from tidemill.operators import index, search


def corpus(spark, n=600):
    """Few long documents among many short ones, over words of which some are everywhere."""
    r = random.Random(5)
    words = ["the", "of", "and"] * 4 + [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 5, 8, 8, 12, 200]))), r.choice(["alpha", "beta the", ""])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, body string, title string")


def asked(spark):
    texts = ["the w1 w2", "of", "w3 w4 w5 w6 and the", "", "missing", None, "W7 w7 the the", " ".join(f"w{i}" for i in range(40))]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r.k, round(r.score, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("fields", [{"body": 0.5}, {"title": 1.0, "body": 0.25}])
def test_hits_equal_those_of_the_whole_table(spark, tmp_path, monkeypatch, fields):
    monkeypatch.setattr(index, "CELL", 8)
    docs, q = corpus(spark), asked(spark)
    made = index.build(docs, "k", fields, f"{tmp_path}/i", slices=3)
    whole = search.posting_list(docs, "k", fields)
    for limit in (1, 10, 5000):
        found = index.find(made, q, limit)
        assert rows(found.hits) == rows(search.keyword(whole, q, "k", limit))
        reads = {r.query_id: (r.blocks, r.read) for r in found.reads.collect()}
        assert set(reads) == {0, 1, 2, 6, 7} and all(0 < read <= blocks for blocks, read in reads.values())
        if limit == 10:
            assert all(read < blocks for blocks, read in reads.values())  # each query skips blocks
        if limit == 5000:
            assert all(read == blocks for blocks, read in reads.values())
    assert rows(index.find(made, q, 10, scale=3.0).hits) == sorted((a, b, round(3 * s, 9), n) for a, b, s, n in rows(index.find(made, q, 10).hits))
    want = whole.groupBy("k", "term").agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).collect()
    assert {(r.k, r.term): (r.weight, r.n) for r in index.postings(made, spark).collect()} == {(r.k, r.term): (r.w, r.n) for r in want}
    again = index.opened(spark, f"{tmp_path}/i")
    assert again == made and rows(index.find(again, q, 3).hits) == rows(index.find(made, q, 3).hits)
    every = search.keyword(whole, q, "k", 0).select("query_id", "k")
    assert sorted(index.matches(made, q).collect()) == sorted(every.collect())


def test_one_slice_is_replaced_and_the_others_are_not_touched(spark, tmp_path):
    docs, q = corpus(spark, 200), asked(spark)
    made = index.build(docs, "k", {"body": 1.0}, f"{tmp_path}/i", slices=4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "blocks").glob("slice=*/*.parquet")}
    of = {r.k: r.s for r in docs.select("k", made.slice_of(F.col("k")).alias("s")).collect()}
    new = docs.withColumn("body", F.when(F.lit(True) & made.slice_of(F.col("k")).eqNullSafe(2), F.concat("body", F.lit(" w1 fresh"))).otherwise(F.col("body"))).where("k <> 7")
    new = new if of[7] == 2 else new.unionByName(docs.where("k = 7"))
    index.replace(made, new, [2])
    assert rows(index.find(made, q, 10).hits) == rows(search.keyword(search.posting_list(new, "k", {"body": 1.0}), q, "k", 10))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "blocks").glob("slice=*/*.parquet")}
    assert {p for p in before if after.get(p) == before[p]} == {p for p in before if "slice=2" not in str(p)}
    index.replace(made, new.where(~made.slice_of(F.col("k")).eqNullSafe(2)), [2])  # a slice can become empty
    assert {of[r.k] for r in index.postings(made, spark).collect()} == {0, 1, 3}


def test_other_analysers_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running runs the runner"), (2, "ran"), (3, None)], "k long, body string")
    made = index.build(docs, "k", {"body": 1.0}, f"{tmp_path}/i", english.terms)
    q = spark.createDataFrame([(1, "run")], "query_id long, text string")
    assert rows(index.find(made, q, 5).hits) == rows(search.keyword(search.posting_list(docs, "k", {"body": 1.0}, english.terms), q, "k", 5, english.terms))
    none = index.build(docs.limit(0).union(docs.where("k = 2")), "k", {"body": 1.0}, f"{tmp_path}/j")
    assert index.find(none, q, 5).hits.count() == 0


def test_a_task_writes_one_file(spark, tmp_path, monkeypatch):
    """Hashes of slice and term once put the blocks of several files into one task."""
    monkeypatch.setattr(index, "FILE", 64)
    docs = spark.createDataFrame([(i, f"w{i % 50} x{i % 7}") for i in range(1000)], "k long, body string")
    made = index.build(docs, "k", {"body": 1.0}, str(tmp_path / "i"), slices=3)
    files = made.blocks(spark).select(F.input_file_name().alias("f"), "slice").distinct().collect()
    parts = [f.f.rsplit("/", 1)[1].split("-")[1] for f in files]
    assert len(files) > 3 and len(parts) == len(set(parts))
