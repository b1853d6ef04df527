"""Label work, agreement, decisions between configurations, and alerts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import labels, measures


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_label_work(spark):
    ex = frame(spark, [("k1", ["A", "b"], ["b", "c"]), ("k2", ["x"], ["x", "y"])], "key string, t array<string>, r array<string>")
    dec = frame(spark, [("k1", [" Z ", "a", "A"])], "key string, terms array<string>")
    assert {r.key: r.label for r in labels.decided(ex, dec, "key", "t", "r").collect()} == {"k1": ["a", "z"], "k2": ["x"]}
    offered = labels.pool(ex, "key", "t", "r", 7)
    assert {(r.key, r.term): r.origin for r in offered.collect()} == {("k1", "a"): "teacher", ("k1", "b"): "both", ("k1", "c"): "rules", ("k2", "x"): "both", ("k2", "y"): "rules"}
    assert sorted(r.position for r in offered.where("key = 'k1'").collect()) == [1, 2, 3]
    verdicts = frame(spark, [("k1", "a", "kept"), ("k1", "b", "dropped"), ("k1", "q", "added"), ("k1", "w", "dropped")], "key string, term string, verdict string")
    assert {(r.origin, r.verdict): r.n for r in labels.provenance(verdicts, offered, "key").collect()} == {("teacher", "kept"): 1, ("both", "dropped"): 1, ("human_only", "added"): 1, ("teacher", "dropped"): 1}
    keep = lambda *x: frame(spark, [("k1", y) for y in x], "key string, term string")
    pairs = labels.pass_pairs(keep("a", "b"), keep("b"), "key", offered.where("key = 'k1'"))
    assert {r.term: (r.a, r.b) for r in pairs.collect()} == {"a": (1, 0), "b": (1, 1), "c": (0, 0)}


@pytest.mark.parametrize("replace,want", [(False, {("q", "a"): 0, ("q", "b"): 1, ("p", "a"): 2}), (True, {("q", "a"): 0, ("p", "a"): 2})])
def test_grades(spark, replace, want):
    s = "query string, key string, grade int"
    got = labels.merge_grades(frame(spark, [("q", "a", 2), ("q", "b", 1), ("p", "a", 2)], s), frame(spark, [("q", "a", 0)], s), ["query", "key"], replace)
    assert {(r.query, r.key): r.grade for r in got.collect()} == want


def test_work_lists_and_prints(spark):
    df = frame(spark, [(c,) for c in "cab"], "key string")
    assert [r.key for r in labels.to_label(df, df.where("key = 'b'"), ["key"]).collect()] == ["a", "c"]
    assert labels.fingerprint(df, "key").first().fingerprint == hashlib.sha256(b"a|b|c").hexdigest()[:12]
    assert labels.digest(df, "key").first() == labels.digest(df.repartition(3), "key").first() and labels.digest(df.limit(0), "key").first().digest == "0"
    assert labels.hold_out(df, "key", 0.1, 1).where("part = 'test'").count() == 1
    row = frame(spark, [("T", "d", ["b", "a"])], "t string, d string, l array<string>")
    turns = json.loads(labels.chat_rows(row, "P", F.col("t"), F.col("d"), "l").first().value)["messages"]
    assert [t["role"] for t in turns] == ["system", "user", "assistant"] and json.loads(turns[2]["content"]) == {"skills": ["a", "b"]}


def test_configurations(spark):
    c = frame(spark, [("base", 0, 0.60, 80.0), ("fast", 1, 0.66, 90.0), ("good", 2, 0.70, 400.0), ("same", 3, 0.70, 450.0), ("slow", 4, 0.80, 900.0)], "config string, position int, ndcg double, p95_ms double")
    got = {r.config: (r.passing, r.chosen) for r in measures.winner(c, "base", "ndcg").collect()}
    assert got == {"base": (False, False), "fast": (True, False), "good": (True, True), "same": (True, False), "slow": (False, False)}
    assert measures.best_config(c.where("p95_ms < 500"), "ndcg").first().config == "good"
    m = frame(spark, [("v1", "mrr", 0.5), ("v2", "mrr", 0.75), ("v1", "x", 1.0)], "version string, metric string, value double")
    assert {r.metric: r.delta for r in measures.compare(m, "v1", "v2").collect()} == {"mrr": 0.25, "x": None}


def test_chat_and_calibration(spark):
    a = frame(spark, [(2, 1, True, False, False, 0.1), (0, 1, False, True, True, 0.2), (1, 1, True, True, False, None)], "faithfulness int, completeness int, cited boolean, must_refuse boolean, refused boolean, cost_usd double")
    r = measures.chat_scores(a).first()
    assert (r.faithfulness, r.completeness, r.refusal_accuracy) == (0.5, 0.5, 0.5) and r.citation_rate == pytest.approx(2 / 3) and r.cost_usd == pytest.approx(0.3)
    assert measures.chat_scores(a.where("not must_refuse")).first().refusal_accuracy == 1.0
    p = frame(spark, [(i % 3, i % 3, i % 2, 0) for i in range(30)], "h int, m int, h2 int, m2 int")
    got = {x.dimension: x for x in measures.calibration(p, {"faith": ("h", "m"), "full": ("h2", "m2")}, "faith").collect()}
    assert got["faith"].kappa == 1.0 and got["full"].kappa == 0.0 and got["faith"].trustworthy
    assert not measures.calibration(p.limit(10), {"faith": ("h", "m")}, "faith").first().trustworthy
    hits = frame(spark, [(1, 1, True), (1, 2, False), (2, 1, True), (2, 11, False)], "query_id int, rank int, ok boolean")
    assert measures.hit_share(hits, F.col("ok")).first().share == 0.75


def test_quantile_and_alerts(spark):
    h = frame(spark, [("a", 1.0, 2), ("a", 2.0, 6), ("a", float("inf"), 8), ("b", 1.0, 0), ("b", float("inf"), 4)], "k string, le double, n long")
    assert {r.k: r.quantile for r in measures.bucket_quantile(h, ["k"], 0.5).collect()} == {"a": 1.5, "b": 1.0}
    e = frame(spark, [("x", t, v) for t, v in ((0, 0), (60, 1), (120, 1), (180, 1), (240, 0), (300, 1), (360, None))], "k string, t long, v int").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.t for r in measures.firing(e, ["k"], "ts", F.col("v") == 1, 120).where("firing").collect()] == [180]
