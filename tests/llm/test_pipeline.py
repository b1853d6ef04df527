import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import CLASHES, SCHEMA, no_docs
from tests.llm.test_decontam import brute
from tests.llm.test_exact import norm
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tidemill.llm import bpe, common, langid


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    model = langid.learn(docs)
    rows = [r for r in rows if (p := model.predict(r.text))[0] != "und" and p[1] >= langid.MIN_SHARE]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    rows = list(first.values())
    low = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    rows = [r for r, c in zip(rows, low, strict=True) if r.doc_id == c]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = [(r, brute(r.text, items)) for r in rows]
    rows = [r for r, (n, hit, _) in found if not (hit > 0 and 20 * hit >= n)]
    want = {r.doc_id: len(bpe.encoder().encode(r.text)) for r in rows}
    assert 0 < len(want) < docs.count()

    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == columns
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(train)
    english = train.where("lang = 'en' and length(text) > 200").orderBy("doc_id").first().text
    other = train.where("lang = 'en' and length(text) > 200").orderBy(F.desc("doc_id")).first().text
    bench = " ".join(sorted(other.split()[:40]))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, english, "en", "s", 1), (5, english, "en", "s", 1), (5, english + " Quite another end here.", "en", "s", 1), (None, bench, "en", "s", 1), (7, "123 ½", None, None, None), (7, " ".join(reversed(english.split())), "en", "s", 1), (None, None, None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(k))
    now = langid.keep_identified(docs, model)
    assert sorted(r.text for r in now.collect()) == sorted(t for _, t, *_ in rows if t and any(map(str.isalpha, t)))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    # (1, english) stays for its equals and near copies; the second row of id 7 stays though the first went.
    low = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in (rows[0], rows[2])])
    want = [(1, english), (7, rows[5][1])] + ([(5, rows[2][1])] if low[1] == 5 else [])
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(want)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(want)


def test_empty_table(spark, sf_dir, tmp_path):
    no_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_tables_are_deleted(spark, sf_dir):
    import os

    at = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    out = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and next(iter(left)).startswith("tidemill-decontamination") and out.count()


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
