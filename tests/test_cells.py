"""Vector cells: the index against an exact scan, and the join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import cells, search


def clustered(spark, n=1200, dim=12, kinds=15, spread=0.25):
    r = np.random.default_rng(8)
    centres = r.normal(size=(kinds, dim))
    rows = [(i, [float(x) for x in centres[i % kinds] + spread * r.normal(size=dim)], "whole" if i % 3 else "section", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "k long, embedding array<double>, strategy string, g int")


def test_recall_and_filled_limits(spark, tmp_path):
    df = clustered(spark)
    made = cells.build(df, "k", f"{tmp_path}/v", cells=30, keep=("strategy",))
    assert made.rows(spark).count() == 1200 and 1 <= made.probes < 25
    q = df.where("k % 20 = 0").select(F.col("k").alias("query_id"), F.col("embedding").alias("vector"))
    for where, rows in ((None, df), (F.col("strategy") == "section", df.where("strategy = 'section'"))):
        got = cells.find(made, q, 10, where, exclude_self=True).collect()
        want = search.vector(rows, q, "k", 10, exclude_self=True).collect()
        assert len(got) == 600 and all(r.query_id != r.k for r in got)
        both = {(r.query_id, r.k) for r in got} & {(r.query_id, r.k) for r in want}
        assert len(both) >= 0.95 * 600
    again = cells.opened(spark, f"{tmp_path}/v")
    assert (again.path, again.key, again.probes) == (made.path, made.key, made.probes) and (again.centres == made.centres).all()
    whole = cells.find(again, q, 10, probes=30)
    assert sorted((r.query_id, r.k, round(r.score, 9), r["rank"]) for r in whole.collect()) == sorted((r.query_id, r.k, round(r.score, 9), r["rank"]) for r in search.vector(df, q, "k", 10).collect())


def test_probing_goes_on_until_the_limit_is_full(spark, tmp_path):
    df = clustered(spark).withColumn("strategy", F.when(F.col("k") % 400 == 7, "rare").otherwise("common"))
    made = cells.build(df, "k", f"{tmp_path}/v", cells=30, keep=("strategy",))
    q = df.where("k % 300 = 0").select(F.col("k").alias("query_id"), F.col("embedding").alias("vector"))
    got = cells.find(made, q, 3, F.col("strategy") == "rare", probes=1)
    assert {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()} == {0: 3, 300: 3, 600: 3, 900: 3}
    assert cells.find(made, q, 9, F.col("strategy") == "rare", probes=1).count() == 4 * 3  # there are no more
    assert cells.find(made, q, 9, F.col("strategy") == "none", probes=1).count() == 0


def all_pairs(rows, threshold):
    m = np.array([r.embedding for r in rows])
    s = cells.unit_rows(m) @ cells.unit_rows(m).T
    return {(min(a.k, b.k), max(a.k, b.k)) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a.g == b.g and s[i, j] >= threshold}


@pytest.mark.parametrize(("n", "part"), [(1, 4096), (1, 50), (12, 40), (25, 4096)])
def test_join_equals_all_pairs(spark, n, part):
    df = clustered(spark, 500)
    got = cells.similar(df, "k", 0.8, F.col("g"), cells=n, part_rows=part)
    rows = got.pairs.collect()
    assert len({(r.low, r.high) for r in rows}) == len(rows)
    assert {(r.low, r.high) for r in rows} == all_pairs(df.collect(), 0.8)
    reach = got.reach().first()
    assert reach.compared + reach.left_out == sum(x * (x - 1) // 2 for x in [r["count"] for r in got.parts.groupBy("g").count().collect()])
    if n == 25:
        assert reach.left_out > reach.compared  # most cells of a clustered table never meet


def test_top_pairs_rise_above_the_threshold(spark):
    df = clustered(spark, 500)
    every = sorted(cells.similar(df, "k", 0.5, cells=6, part_rows=60).pairs.collect(), key=lambda r: (-r.similarity, r.low, r.high))
    kept = cells.similar(df, "k", 0.5, cells=6, part_rows=60, top=20).pairs.collect()
    assert len(kept) < len(every) / 2
    assert [(r.low, r.high) for r in sorted(kept, key=lambda r: (-r.similarity, r.low, r.high))[:20]] == [(r.low, r.high) for r in every[:20]]


def test_equal_vectors_are_a_star(spark, monkeypatch):
    rows = [(i, [1.0, 0.0], 0) for i in range(5)] + [(9, [0.0, 1.0], 0), (10, [1.0, 0.1], 0), (11, [1.0, 0.0], 1), (12, None, 0)]
    df = spark.createDataFrame(rows, "k long, embedding array<double>, g int")
    for part, broadcast in ((4096, 500_000), (1, 0)):
        monkeypatch.setattr(cells, "EQUAL_ROWS", broadcast)
        got = {(r.low, r.high) for r in cells.similar(df, "k", 0.9, F.col("g"), part_rows=part).pairs.collect()}
        assert got == {(0, i) for i in (1, 2, 3, 4)} | {(0, 10)}
    none = cells.similar(df.where("k = 12"), "k", 0.9, F.col("g"))
    assert none.pairs.count() == 0 and tuple(none.reach().first()) == (0, 0)


def test_many_groups_are_small_ones(spark, monkeypatch):
    monkeypatch.setattr(cells, "MOST_RADII", 3)
    df = clustered(spark, 200).withColumn("g", F.col("k") % 20)
    got = {(r.low, r.high) for r in cells.similar(df, "k", 0.8, F.col("g"), cells=8, part_rows=4).pairs.collect()}
    assert got == all_pairs(df.collect(), 0.8)
