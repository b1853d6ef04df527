"""Round trips of files, and what the readers leave out."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import files


def test_jsonl(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"a": 1, "b": ["x"]}\n\n{"a": 2}\nbroken\n')
    df = files.read_jsonl(spark, str(p), "a long, b array<string>")
    rows = sorted(map(tuple, df.collect()))
    files.write_jsonl(df, str(tmp_path / "out"))
    assert rows == [(1, ["x"]), (2, None)] == sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), "a long, b array<string>").collect()))


def test_pools_and_decisions(spark, tmp_path):
    (tmp_path / "pool.json").write_text(json.dumps({"s:1": ["b", "a"], "s:2": []}))
    assert sorted(map(tuple, files.read_pool(spark, str(tmp_path / "pool.json")).collect())) == [("s:1", 0, "b"), ("s:1", 1, "a")]
    (tmp_path / "dec.json").write_text(json.dumps({"s:1": {"keep": ["a"], "drop": ["b"], "added": []}}))
    assert sorted(map(tuple, files.read_decisions(spark, str(tmp_path / "dec.json")).collect())) == [("s:1", "a", "kept"), ("s:1", "b", "dropped")]


def test_graded_queries(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text("queries:\n- {id: q1, query: x, verified: true, judgements: {'a:b:1': 2, 'a:2': 0}}\n- {id: q2, query: y, verified: true, judgements: {'a:2': 0}}\n- {id: q3, query: z}\n")
    q, j = files.read_graded(spark, str(tmp_path / "g.yaml"))
    assert ("q1", "a", "b:1", 2) in {tuple(r) for r in j.collect()} and q.count() == 3
    assert [r.query_id for r in files.verified_only(q, j).collect()] == ["q1"]


def test_history(spark, tmp_path):
    p = str(tmp_path / "h")
    for day, v in (("2026-01-01", 0.123456), ("2026-01-02", 0.5)):
        files.append_history(spark.createDataFrame([(day, "s", "c", "abc", 3, {"mrr": v, "ndcg": 1.0})], "timestamp string, suite string, config string, git_sha string, queries long, metrics map<string,double>"), p)
    assert [r.value for r in files.read_history(spark, p, "s", "mrr").collect()] == [0.1235, 0.5]
    assert [r.timestamp for r in files.read_history(spark, p, metric="mrr", limit=1).collect()] == ["2026-01-02"]
    old = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "suite string, metric string, value double")
    assert sorted(map(tuple, files.replace_suite(old, old.where("suite = 'a'").withColumn("value", F.lit(9.0))).collect())) == [("a", "m", 9.0), ("b", "m", 2.0)]


def test_prompts_take_the_numeric_latest(spark, tmp_path):
    for v in ("v2", "v10", "v9"):
        (tmp_path / "chat").mkdir(exist_ok=True)
        (tmp_path / "chat" / f"{v}.md").write_text(v.upper())
    assert [tuple(r) for r in files.latest_prompts(files.read_prompts(spark, str(tmp_path))).collect()] == [("chat", "v10", "V10")]


def test_seed(spark, tmp_path):
    (tmp_path / "s.ts").write_text('x\n  { name: "A \\"B\\"", atsProvider: "lever", atsSlug: "ab", city: "Pune" },\n  { name: "C", atsProvider: "lever", atsSlug: "AB", city: "Pune" },\n{ name: "D", atsProvider: "other", atsSlug: "d" }\n{ name: "E", atsProvider: "ashby", atsSlug: "e" }\n')
    got = {r.name: (r.missing, r.duplicate) for r in files.read_seed(spark, str(tmp_path / "s.ts")).collect()}
    assert got == {'A "B"': (False, True), "C": (False, True), "E": (True, False)}


def test_text_sinks(spark):
    df = spark.createDataFrame([('a"b', 1.5)], "k string, v double")
    assert [r.line for r in files.exposition(df, "m", ["k"], "v").collect()] == ['m{k="a\\"b"} 1.5']
    assert files.markdown(df) == '| k | v |\n| --- | --- |\n| a"b | 1.5000 |'
