"""Clusters of planted themes, reranking and matches."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.operators import answers, topics

THEMES = ("apple pear plum cherry", "engine wheel brake gear")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(w for n, w in enumerate(THEMES[i % 2].split()) if n != i % 3) + " common") for i in range(24)]
    return spark.createDataFrame([*rows, (24, None), (25, "")], "id long, text string")


def test_weights_by_formula(spark):
    two = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc")], "id long, text string")
    got = {(r.id, r.term): r.weight for r in topics.weights(two, "id", "text", bigrams=False).collect()}
    a, b = 2 * (math.log(3 / 2) + 1), 1.0
    assert got[1, "aa"] == pytest.approx(a / math.hypot(a, b)) and got[1, "bb"] == pytest.approx(b / math.hypot(a, b))
    assert {r.term for r in topics.term_counts(two, "id", "text", ["bb"]).collect()} == {"aa", "aa aa", "cc"}


def test_clusters_find_the_themes(spark, docs):
    terms = topics.weights(docs, "id", "text", min_df=2, max_df=0.6).cache()
    assert "common" not in {r.term for r in terms.collect()}
    found = topics.cluster(topics.vectors(terms, "id"), "id", k=2, restarts=3).cache()
    side = {r.id: r.cluster for r in found.collect()}
    assert len(side) == 24 and len({side[i] for i in range(0, 24, 2)}) == 1 and side[0] != side[1]
    skills = docs.where("id % 2 = 0").select("id", F.lit("fruit").alias("skill"))
    told = {r.cluster: r for r in topics.describe(found, terms, skills, "id").collect()}
    assert told[side[0]].top_skills == ["fruit"] and told[side[1]].top_skills == [] and told[side[1]].postings == 12
    assert set(told[side[1]].top_terms[0].split()) <= set(THEMES[1].split())


def test_best_k_and_too_few(spark):
    rows = spark.createDataFrame([(i, [float(i % 3) * 10 + i / 1000, float(i % 3 == 1) * 10]) for i in range(30)], "id long, v array<double>")
    points = topics.dense(rows, "id", "v").cache()
    assert topics.cluster(points, "id", ks=(2, 3, 4), restarts=2).select("cluster").distinct().count() == 3
    with pytest.raises(ValueError):
        topics.cluster(points.limit(5), "id", k=2)


def test_rerank_keeps_the_first_rank(spark):
    hits = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)], "query_id long, key long, score double, rank int")
    asked = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    read = spark.createDataFrame([(10, "blue"), (11, "a red fox")], "key long, document string")
    got = answers.rerank(hits, asked, read, "key").orderBy("rank").collect()
    assert [(r.key, r.first_stage, r.score) for r in got] == [(11, 2, 1.0), (10, 1, 0.0), (12, 3, 0.0)]
    blended = answers.rerank(hits, asked, read, "key", alpha=1.0).orderBy("rank").collect()
    assert [r.key for r in blended] == [10, 11, 12]


def test_prompts_and_matches(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 1), (2, 10, 0.1, 1)], "query_id long, key long, score double, rank int")
    read = spark.createDataFrame([(10, "T", "C", None, True, "body")], "key long, title string, company string, location string, remote boolean, body string")
    asked = spark.createDataFrame([(1, "why?"), (2, "no")], "query_id long, text string")
    got = {r.query_id: r for r in answers.prompts(answers.gated(hits, hits), read, asked, "key").collect()}
    assert got[1].prompt == "[1] T at C (remote)\nbody\n\nQuestion: why?" and got[1].sources == [10]
    assert got[2].prompt is None and got[2].n_sources == 0
    people = spark.createDataFrame([(1, ["sql", "python"])], "query_id long, skills array<string>")
    wants = spark.createDataFrame([(10, ["sql", "go"])], "key long, skills array<string>")
    m = answers.matches(hits, people, wants, "key").first()
    assert (m.fit, m.has, m.gap) == (0.5, ["sql"], ["go"])
    q = people.select(answers.profile_query(F.col("skills"), F.lit("x")).alias("a"), answers.profile_query(F.array().cast("array<string>"), F.lit("y" * 500)).alias("b")).first()
    assert q.a == "sql python" and len(q.b) == 400


def test_texts_are_weighed_where_they_lie(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 17}é" for j in range(i % 9)) + " a  x_1, the B-b9") for i in range(60)] + [(60, None), (61, "")]
    many = spark.createDataFrame(rows, "id long, text string").repartition(3).cache()
    told = lambda df: sorted((r.id, r.term, r.tf, r.df, round(r.raw, 9), round(r.weight, 9)) for r in df.collect())
    joined = told(topics.weights(many, "id", "text", ["the"], max_features=None))
    monkeypatch.setattr(topics, "TALLIED", (4, 2))
    monkeypatch.setattr(topics, "SLICE", 5)
    own = topics.weights(many, "id", "text", ["the"])
    assert told(own) == joined and ("x_1 b9" in {r[1] for r in joined})
    top = topics.keywords(many, "id", "text", 2, stop=["the"])
    for df in (own, top):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan and "Window" not in plan
    best = {}
    for r in sorted(joined, key=lambda r: (r[0], -r[4], r[1])):
        best.setdefault(r[0], []).append(r[1])
    assert {(r.id, r["rank"]): r.term for r in top.collect()} == {(i, n + 1): term for i, all_ in best.items() for n, term in enumerate(all_[:2])}


@pytest.mark.parametrize("sparse", [True, False])
def test_fits_share_passes(spark, sparse, monkeypatch):
    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    from tidemill.operators import kmeans

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6)).round(3) + 4 * np.eye(6)[np.arange(90) % 3]
    x[rng.random(x.shape) < 0.3] = 0
    rows = [(i, Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(p) if v]) if sparse else Vectors.dense(p)) for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, ["id", "features"]).repartition(3).cache()
    passes, sums = [], kmeans.Points.sums
    monkeypatch.setattr(kmeans.Points, "sums", lambda self, fits, *a, **k: passes.append(len(fits)) or sums(self, fits, *a, **k))
    with topics.held(points):
        scores = dict(topics.silhouettes(points, range(2, 7), 4))
        assert passes[0] == 20 and len(passes) <= kmeans.STEPS + 2
        for k in range(2, 7):
            model = topics.k_means(points, k, 4)
            far = ((x[:, None] - model.centers) ** 2).sum(axis=2)
            found = model.transform(points).join(points, "id").cache()
            assert {r.id: r.prediction for r in found.collect()} == dict(enumerate(far.argmin(axis=1).tolist()))
            assert model.cost == pytest.approx(far.min(axis=1).sum(), rel=1e-5)
            assert scores[k] == pytest.approx(ClusteringEvaluator().evaluate(found), rel=1e-5)
            own = np.stack([x[far.argmin(axis=1) == c].mean(axis=0) for c in range(k)])
            assert np.abs(own - model.centers).max() < 1e-3
        assert len(passes) <= kmeans.STEPS + 2


def test_many_fits_multiply_few_directions(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemill.operators import kmeans

    rng, size, n = np.random.default_rng(5), 400, 3000
    themes = rng.random((12, size)) ** 8
    x = np.stack([np.where(rng.random(size) < 0.1, themes[i % 12] + 0.01 * rng.random(size), 0.0) for i in range(n)])
    x[7] = 0
    x = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]).astype(np.float32)
    row, at = np.nonzero(x)
    each = np.bincount(row, minlength=n).astype(np.int32)
    columns = [np.arange(n), each, np.square(x.astype(float)).sum(axis=1), at.astype(np.int32), x[row, at]]
    block = kmeans._Block.packed(pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], list("abcde")))
    pieces = list(block.pieces())
    assert pieces[0][0] == 0 and pieces[-1][1] == n and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    assert len(pieces) > 1 and max(each[a:b].sum() for a, b in pieces) <= kmeans.PACKED[0]

    means = np.stack([x[np.arange(n) % 12 == c].mean(axis=0) for c in range(12)])
    fits = [means[rng.permutation(12)[:k]] * 0.9 + rng.random((k, 12)) @ means / 60 + 2e-5 * rng.random((k, size)) for k in range(3, 11) for _ in range(6)]
    whole, few = (kmeans._Centres(fits, size, np.float32, w) for w in (True, False))
    pairs, chosen = [], kmeans._Block.chosen
    monkeypatch.setattr(kmeans._Block, "chosen", lambda self, rows, *a: pairs.append(len(rows)) or chosen(self, rows, *a))
    owners, far = few.owners(block, 0, n), whole.norms + block.squares[:, None] - 2.0 * (x @ whole.columns)
    assert few.basis is not None and few.basis.shape[1] <= len(whole.norms) // 4 and sum(pairs) < 0.1 * far.size
    best = np.stack([far[:, a:b].min(axis=1) for a, b in zip(whole.cuts[:-1], whole.cuts[1:], strict=True)], axis=1)
    assert np.abs(np.take_along_axis(far, owners, axis=1) - best).max() < 1e-6

    wrong = rng.integers(0, 3, owners.shape) + whole.cuts[:-1]
    mixed = np.where((np.arange(n) % 50 == 0)[:, None], wrong, owners)  # more combinations than there is room for
    own, total = np.zeros((n, len(whole.norms))), np.zeros((len(whole.norms), size))
    np.put_along_axis(own, mixed, 1.0, axis=1)
    groups = kmeans._together(owners, whole.cuts, size)
    assert 1 <= len(groups) < len(fits) // 2
    for low in (0, 1):
        half = block if low else kmeans._Block.packed(pa.RecordBatch.from_arrays([pa.array([b""], pa.binary())] * 5, list("abcde")))
        for group in groups:
            group.add(half, half.values.astype(float), mixed[: half.n], total)
    for group in groups:
        group.told(total)
    assert np.allclose(total, own.T @ x.astype(float), atol=1e-6)


@pytest.mark.parametrize("bigrams", [True, False])
def test_rare_terms_are_not_handed_on(spark, monkeypatch, bigrams):
    rows = [(i, " ".join(f"w{min(i * j % 97, j)}" for j in range(60)) + f" own{i} own{i}b and own{i}c") for i in range(200)] + [(200, None), (201, "")]
    many = spark.createDataFrame(rows, "id long, text string").repartition(3).cache()
    told = lambda n, **o: sorted(map(tuple, topics.vocabulary(many, "text", ["and"], max_features=n, bigrams=bigrams, **o).collect()))
    limits = [(7, {}), (60, {"min_df": 2, "max_df": 0.6}), (7, {"max_df": 0.001})]
    before = [told(n, **o) for n, o in limits]
    handed, tally = [], topics._tally
    monkeypatch.setattr(topics, "_tally", lambda *a: handed.append(tally(*a).count()) or tally(*a))
    monkeypatch.setattr(topics, "HASHED_BYTES", 0)
    for bits in (16, 6):  # 6: nearly all terms share their hash with others
        monkeypatch.setattr(topics, "BITS", bits)
        assert [told(n, **o) for n, o in limits] == before
    assert min(handed) < 100 < 600 < max(handed)
