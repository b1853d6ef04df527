"""Exact percentiles by counting, and running sums by ranges."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import measures
from tidemill.sources import boards


def values(kind, r):
    return {
        "uniform": lambda: r.uniform(-5, 5), "wide": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300), "ties": lambda: float(r.randrange(4)),
        "near": lambda: 1.0 + r.randrange(1000) * 2**-52, "one": lambda: 7.0, "odd": lambda: r.choice([0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, None, 1.0]),
    }[kind]()


@pytest.mark.parametrize("kind", ["uniform", "wide", "ties", "near", "one", "odd"])
def test_percentiles_by_counting_equal_those_by_sorting(spark, kind):
    r = random.Random(kind)
    rows = [(g, h, values(kind, r)) for g, h, n in (("a", 1, 900), ("a", None, 300), ("b", 1, 1), (None, 2, 40)) for _ in range(n)] + [("c", 3, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    qs = {"low": 0.01, "p50": 0.5, "p95": 0.95, "top": 1.0}
    want = {}
    for g, h in {x[:2] for x in rows}:
        own = sorted((x[2] for x in rows if x[:2] == (g, h) and x[2] is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        want[g, h] = tuple(repr(own[math.ceil(q * len(own)) - 1] + 0.0) if own else "None" for q in qs.values())
    for at_once in (10**6, 3):
        got = measures.nearest_rank(df, ["g", "h"], "v", qs, at_once).collect()
        assert {(x.g, x.h): tuple(repr(x[q] + 0.0) if x[q] is not None else "None" for q in qs) for x in got} == want


def test_integers_stay_integers(spark):
    got = measures.nearest_rank(spark.range(1000).selectExpr("id % 2 AS g", "id AS v"), ["g"], "v", {"m": 0.5}, 10)
    assert got.dtypes == [("g", "bigint"), ("m", "bigint")] and {x.g: x.m for x in got.collect()} == {0: 498, 1: 499}


@pytest.mark.parametrize("limit", [0, 1, 7, 100, 1500, 10**6])
def test_boards_until_enough(spark, limit):
    r = random.Random(limit)
    df = spark.createDataFrame([(i, r.choice([0, 0, 1, 3, 40]), f"b{i}") for i in r.sample(range(1000), 300)], "position long, usable long, name string").repartition(5)
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("_s", F.coalesce(F.sum("usable").over(before), F.lit(0))).where(F.col("_s") < limit).drop("_s")
    got = boards.until_enough(df, limit)
    assert got.columns == df.columns and sorted(got.collect()) == sorted(want.collect())
    assert boards.until_enough(df.limit(0), limit).count() == 0
