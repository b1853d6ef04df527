import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import common, exact
from tidemill.llm.common import keyed


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def check(got, rows):
    """refine()'s rows against groups of (id, text) rows made one by one."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids), key=str)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == want
    kept = [r.id for r in got if r.kept]
    assert sorted(kept, key=str) == sorted((min((x for x in ids if x is not None), default=None) for ids in groups.values()), key=str)


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(exact, "BITS", bits)  # a full bitmap only means more rows are hashed
    got = exact.refine(*keyed(odd_docs(spark))).collect()
    check(got, [r[:2] for r in odd_rows()])


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_hot_groups_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(common, "HOT_GROUPS", 2)
    rows = [(i, f"text {0 if i % 3 == 0 else i % 40 if i % 5 else i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(exact.refine(*keyed(docs)).collect(), rows)
    assert sorted(norm(r.text) for r in exact.keep_first(docs).collect()) == sorted({t for _, t in rows})


def test_only_survivors_are_hashed(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "bb"), (3, "cc"), (4, "dd"), (5, "dd")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    rows, key = keyed(spark.read.parquet(f"{tmp_path}/d"))
    seen = []
    settle = exact.settle
    exact.settle = lambda df, label: seen.append((label, settle(df, label))) or seen[-1][1]
    try:
        exact.refine(rows, key).collect()
    finally:
        exact.settle = settle
    hashed = dict(seen)["exact-full"]
    assert {r.id for r in hashed.where("sha is not null").collect()} == {4, 5}


def test_repeated_ids_of_different_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (5, "a"), (5, "b"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in exact.keep_first(docs).collect()), key=str) == [(1, "a"), (5, "b"), (None, "c")]


def test_keep_first_keeps_columns_and_one_of_each(spark):
    docs = odd_docs(spark)
    got = exact.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(r[1]) for r in odd_rows()})


def test_empty(spark):
    assert exact.refine(*keyed(no_docs(spark))).count() == 0
    assert exact.keep_first(no_docs(spark)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = exact.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_any_table_has_row_keys(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/p")
    df.write.json(f"{tmp_path}/j")
    parquet, text = spark.read.parquet(f"{tmp_path}/p"), spark.read.schema(df.schema).json(f"{tmp_path}/j")
    for docs in (df, parquet, parquet.where("doc_id is not null").select("doc_id", "text"), text, parquet.unionByName(text), parquet.repartition(3), parquet.where("rand() >= 0"), parquet.withColumnRenamed("text", "_metadata").select("doc_id", F.col("_metadata").alias("text"), F.lit(1).alias("_metadata"))):
        own, key = keyed(docs)
        n = docs.count()
        assert own.select(key).distinct().count() == n and own.drop(key).columns == docs.columns
        assert sorted(r.text for r in exact.keep_first(docs).collect()) == ["a", "b"]
