"""The table function, the estimator, the stream of threads, canonical JSON and the reranking grid."""

import hashlib
import json
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemill.functions import chunks, tables, text
from tidemill.operators import answers, encoder, experiments
from tidemill.sources import threads


def test_lateral_chunks_equal_the_columns(spark):
    r = random.Random(2)
    bits = ["word " * 30, "x" * 950, "y" * 2000, "short", "", "see https://a.b/c now", "Please mention the word LOBSTER when applying.", "é\xa0ü\t z", "\n", " \n \n", "w" * 899, "tail end"]
    rows = [(i, f"head {i}", "\n".join(r.choice(bits) for _ in range(r.randrange(8)))) for i in range(150)] + [(998, "h", None), (999, "h", "")]
    df = spark.createDataFrame(rows, "id long, head string, body string")
    df.createOrReplaceTempView("lateral_postings")
    tables.register(spark)
    for strategy in chunks.STRATEGIES:
        got = spark.sql(f"SELECT p.id, c.chunk_index AS i, c.content FROM lateral_postings p, LATERAL chunks('{strategy}', head, body) c").collect()
        want = df.select("id", F.posexplode(chunks.chunks(strategy, F.col("head"), F.col("body"))).alias("i", "content")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="unknown chunk strategy"):
        spark.sql("SELECT c.* FROM lateral_postings, LATERAL chunks('none', head, body) c").collect()


def test_encoder_is_fitted_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, "Python and SQL"), (2, "python, Docker"), (3, None), (4, "nothing")], "id long, text string")
    model = Pipeline(stages=[encoder.SkillEncoder(min_texts=2)]).fit(df)
    assert model.stages[0].names() == ["skill:python"]
    whole = encoder.SkillEncoder(outputCol="f").fit(df)
    assert len(whole.names()) == len(whole.getSkills()) > 50
    rows = {r.id: r.f for r in whole.transform(df).collect()}
    named = lambda v: {n for n, x in zip(whole.getSkills(), v.toArray()) if x}
    assert named(rows[1]) == {"python", "sql"} and named(rows[2]) == {"python", "docker"} and not named(rows[3]) and not named(rows[4])
    for first, kind in ((model, PipelineModel), (whole, encoder.SkillModel)):
        at = f"file://{tmp_path}/{kind.__name__}"
        first.write().overwrite().save(at)
        again = kind.load(at)
        assert again.transform(df).collect() == first.transform(df).collect()
    own = encoder.SkillEncoder(skills=["a"], spellings=json.dumps({"a": ["nothing"]}))
    own.save(f"file://{tmp_path}/own")
    assert [list(r.features) for r in encoder.SkillEncoder.load(f"file://{tmp_path}/own").fit(df).transform(df).orderBy("id").collect()] == [[0.0], [0.0], [0.0], [1.0]]


def board(at, pages):
    """Files that answer as the service does: threads by age, and pages of comments."""
    hits = [{"objectID": t, "created_at_i": int(t)} for t in pages] + [{"title": "no id"}]
    (at / "search.json").write_text(json.dumps({"hits": hits}))
    for t, own in pages.items():
        for n in range(max(1, len(own))):
            (at / f"{t}_{n}.json").write_text(json.dumps({"nbPages": len(own), "hits": [{"objectID": i, "text": f"c{i}"} for i in (own[n] if own else [])]}))


def read(spark, at, checkpoint, limit=0):
    rows = []
    stream = threads.threads(spark, f"file://{at}/search.json", f"file://{at}/{{thread}}_{{page}}.json", limit, 2)
    q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((t, p, i) for t, p, i, _ in rows)


def test_threads_are_read_once_each(spark, tmp_path):
    board(tmp_path, {"1": [[10, 11]], "2": [[20, 21], [22]], "3": [[30, 31]]})
    first = read(spark, tmp_path, tmp_path / "cp")
    assert first == [("2", 0, "20"), ("2", 0, "21"), ("2", 1, "22"), ("3", 0, "30"), ("3", 0, "31")]  # the latest two threads
    assert read(spark, tmp_path, tmp_path / "cp") == []  # a restart from the offset reads nothing twice
    board(tmp_path, {"2": [[20, 21], [22]], "3": [[30, 31], [32, 33]], "4": [[40]]})
    assert read(spark, tmp_path, tmp_path / "cp") == [("3", 1, "32"), ("3", 1, "33"), ("4", 0, "40")]
    assert read(spark, tmp_path, tmp_path / "cp") == []


def test_a_limit_over_both_threads(spark, tmp_path):
    board(tmp_path, {"2": [[20, 21], [22, 23], [24]], "3": [[30, 31]]})
    assert read(spark, tmp_path, tmp_path / "a", 5) == [("2", 0, "20"), ("2", 0, "21"), ("2", 1, "22"), ("3", 0, "30"), ("3", 0, "31")]
    assert read(spark, tmp_path, tmp_path / "b", 1) == [("3", 0, "30")]


def test_payload_hashes_equal_canonical_json(spark):
    rows = ['{"b":1.0,"a":[1,2.50,-0.0,1e5,1E-7,12345678901234567890]}', '{"é":"ü\\n\\u00e9/","a":null}', "[]", '"x"', "nonsense", None, '{"a":1,"a":2}', '{"a":"\\ud800"}', '{"z":{"y":true,"x":{}}}', "1.0", "1"]
    got = [r.h for r in spark.createDataFrame([(r,) for r in rows], "p string").coalesce(1).select(text.payload_hash(F.col("p")).alias("h")).collect()]

    def want(p):
        try:
            return hashlib.md5(json.dumps(json.loads(p), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    assert got == [want(p) for p in rows] and got[-1] != got[-2] and got[4] is None and got[7] is None


def test_every_setting_of_the_grid(spark):
    first = spark.createDataFrame([(q, k, 1.0 / k, k) for q in (1, 2) for k in range(1, 51)], "query_id long, key long, score double, rank int")
    queries = spark.createDataFrame([(1, "a b"), (2, "z")], "query_id long, text string")
    docs = spark.createDataFrame([(k, "a " * (k % 3), "x " * 300 + "b", "b z" if k == 40 else None) for k in range(1, 51)], "key long, snippet string, head string, section string")
    models = {"base": answers.overlap, "small": lambda q, d: F.length(d).cast("double")}
    rows = {}
    for r in experiments.run(first, queries, docs, "key", models, 10).collect():
        rows.setdefault((r.config, r.query_id), {})[r["rank"]] = r.key
    assert {c for c, _ in rows} == {s.name for s in experiments.GRID} and len(experiments.GRID) == 14
    best = {c: [v[n] for n in sorted(v)] for (c, q), v in rows.items() if q == 1}
    assert best["first stage"] == list(range(1, 11))
    assert best["shipped"] == [k for k in range(1, 31) if k % 3][:10]
    assert best["document head"][0] == 1 and best["length 256"] == best["shipped"]
    assert best["document section"] == list(range(1, 11))  # key 40 lies outside the pool
    assert best["small"][0] == 2 and best["alpha 0.7"][0] == 1
