"""Logs, runs, the write path, streams, the index and the analysed search."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import english
from tidemill.operators import embed, runs, search, topics
from tidemill.plans import retrieval
from tidemill.storage import scratch, settle, shared_dir
from tidemill.streaming import events


def test_a_run_that_fails_is_noted(spark, tmp_path):
    at = str(tmp_path / "runs")
    assert runs.lifecycle(spark, at, "r1", "a", lambda: {"fetched": 3, "inserted": 2}) == "ok"
    assert runs.lifecycle(spark, at, "r2", "b", lambda: 1 / 0) == "failed"
    runs.start(spark, at, "r3", "c")
    now = {r.run_id: r for r in runs.current(runs.store(spark, at, runs.RUN)).collect()}
    assert [(now[k].status, now[k].fetched) for k in ("r1", "r2", "r3")] == [("ok", 3), ("failed", 0), ("running", None)]
    assert "division" in now["r2"].error and now["r3"].finished_at is None and now["r1"].finished_at >= now["r1"].started_at


def test_a_log_never_breaks_its_caller(spark, tmp_path):
    calls = spark.createDataFrame([("chat", 5, True)], "feature string, prompt_tokens long, ok boolean")
    assert runs.log_calls(calls, str(tmp_path / "calls"))
    assert not runs.log_calls(calls, "no-such-scheme://x")
    assert runs.store(spark, str(tmp_path / "calls"), runs.CALL).first().prompt_tokens == 5
    assert runs.store(spark, str(tmp_path / "none"), runs.CALL).count() == 0


def test_changes_of_a_batch(spark):
    rows = [(1, "A", 1), (1, "A", 2), (1, "B", 3), (1, "A", 4), (2, "X", 1), (3, None, 1), (4, "N", 1)]
    batch = spark.createDataFrame(rows, "k long, h string, seq long")
    latest = spark.createDataFrame([(1, "A"), (2, "Y"), (3, None)], "k long, h string")
    got = events.changes(batch, latest, ["k"], "h", "seq").collect()
    assert sorted((r.k, r.seq) for r in got) == [(1, 3), (1, 4), (2, 1), (4, 1)]


def test_a_batch_that_is_written_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate([[(1, "A", 1), (1, "A", 2)], [(1, "B", 3), (2, "C", 4)], [(1, "B", 5), (2, "D", 6), (1, "A", 7)]]):
        spark.createDataFrame(rows, "k long, h string, seq long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k long, h string, seq long").parquet(src)
        events.capture_changes(stream, out, ["k"], "h", "seq", str(tmp_path / f"cp{n // 2}")).awaitTermination()
    # The third stream has lost its checkpoint: all comes again as its first batch, and takes the first one's place.
    assert sorted({r.seq for r in spark.read.parquet(out).collect()}) == [1, 3, 4, 6, 7]


def test_index_is_built_once(spark):
    rows = [(1, "T", "C", "Pune", "a b c"), (2, "U", None, None, None), (3, "V", "D", None, "x " * 1500)]
    postings = spark.createDataFrame(rows, "posting_id long, title string, company string, location string, description string")
    model = embed.hashing(16)
    none = spark.createDataFrame([], "posting_id long, strategy string, model string, chunk_index int, content string, embedding array<double>")
    first = embed.new_chunks(postings.where("posting_id < 3"), none, "section", model)
    index = embed.merged(none, first)
    rest = embed.new_chunks(postings, index, "section", model)
    assert {r.posting_id for r in rest.collect()} == {3} and rest.count() == 4
    assert embed.new_chunks(postings, index, "whole", model).count() == 3
    assert {(r.posting_id, r.content) for r in index.collect()} == {(1, "T at C, Pune. a b c"), (2, "U")}
    assert embed.first_vectors(postings, index, "section", model.name).count() == 2
    sizes = [sum(x * x for x in r.embedding) for r in index.collect()]
    assert sizes == [pytest.approx(1.0), pytest.approx(1.0)]


def test_analysed_search_equals_a_search_one_by_one(spark, sf_dir):
    docs = [(r.doc_id, english.analysed(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {}
    for r in retrieval.keyword_hits(spark, sf_dir, 20, stems=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        asked = set(english.analysed(b.text))
        scored = sorted((-0.25 * sum(t in asked for t in terms), i) for i, terms in docs if asked & set(terms))[:20]
        assert sorted(got.get(b.item_id, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]


def test_inflected_words_meet(spark):
    docs = spark.createDataFrame([(1, "Data Engineer", "the pipelines"), (2, "Cook", "engineering of soups"), (3, "Nurse", "the")], "k long, title string, body string")
    queries = spark.createDataFrame([(1, "engineers for the pipeline"), (2, "the of")], "query_id long, text string")
    postings = search.posting_list(docs, "k", {"title": 1.0, "body": 0.25}, english.terms)
    hits = search.keyword(postings, queries, "k", 10, english.terms).collect()
    assert [(h.query_id, h.k, h.score) for h in sorted(hits, key=lambda h: h.rank)] == [(1, 1, 1.25), (1, 2, 0.25)]


def test_unknown_modes_raise(spark, sf_dir):
    c, q = retrieval.corpus(spark, sf_dir), retrieval.asked(spark, sf_dir)
    with pytest.raises(ValueError, match="keyword, vector, hybrid"):
        search.search(c, q, "fuzzy")


def test_a_query_without_a_city_has_no_third_list(spark):
    docs = spark.createDataFrame([(1, "x", "Navi Mumbai"), (2, "x", "Pune"), (3, "x", None)], "k long, body string, location string")
    chunks = spark.createDataFrame([(i, "whole", [1.0, i / 10]) for i in (1, 2, 3)], "k long, strategy string, embedding array<double>")
    c = search.Corpus(docs, "k", chunks, {"body": 1.0})
    q = spark.createDataFrame([(1, "x", [1.0, 0.0], ["pune"]), (2, "x", [1.0, 0.0], None)], "query_id long, text string, vector array<double>, city array<string>")
    got = {(r.query_id, r["rank"]): r.k for r in search.search(c, q).collect()}
    assert (got[1, 1], got[2, 1]) == (2, 1)


def test_sparse_vectors_need_no_python(spark):
    terms = spark.createDataFrame([(1, "b", 0.6), (1, "a", 0.8), (2, "c", 1.0)], "k long, term string, weight double")
    got = {r.k: r.features for r in topics.vectors(terms, "k", 10).collect()}
    assert got[1].toArray().tolist() == [0.8, 0.6] + [0.0] * 8 and got[2].indices.tolist() == [2] and got[1].size == 10


def test_settled_tables_go(spark):
    import os

    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    with scratch() as keep:
        settle(spark.range(3), "gone")
        kept = keep(settle(spark.range(4), "kept"))
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and kept.count() == 4


def test_summary_of_nothing(spark):
    from tidemill.operators import trends

    none = spark.createDataFrame([], "posted_at timestamp, source string, remote boolean, skills array<string>, cities array<string>")
    s = trends.summary(none, "posted_at", F.current_timestamp(), "source", "remote", "skills", "cities").first()
    assert (s.postings, s.remote_share, s.sources, s.top_skills) == (0, 0.0, {}, [])


def test_too_few_rows_raise(spark):
    from tidemill.operators import labels

    split = spark.range(60).selectExpr("id", "IF(id < 49, 'train', 'test') AS part")
    with pytest.raises(ValueError, match="training needs 50 rows or more, got 49"):
        labels.training_part(split)
    assert labels.training_part(spark.range(51).selectExpr("id", "'train' AS part")).count() == 51
    with pytest.raises(ValueError, match="clustering needs 20"):
        topics.cluster(topics.dense(spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), "k", "v"), "k")


def test_texts_come_in_bounded_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    assert embed._counts("aa Bb" * 3, embed._Chars(), embed._Buckets(16), 16).tolist() == _stretched(monkeypatch, "aa Bb" * 3, 3)
    seen = embed._Buckets(16)
    for i in range(embed.REMEMBERED + 5):
        seen[str(i)]
    assert len(seen) <= embed.REMEMBERED
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    embed.hashing(16).encode(F.lit("x"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    if before:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def _stretched(monkeypatch, body, stretch):
    monkeypatch.setattr(embed, "STRETCH", stretch)
    return embed._counts(body, embed._Chars(), embed._Buckets(16), 16).tolist()
