import random

from tests.llm.cases import no_docs, odd_docs
from tidemill.llm import licenses


def brute(text, templates, contained=licenses.CONTAINED):
    """Templates whose shingles are contained in some window of the class's width."""
    def sh(w):
        k = min(len(w), 5)
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []

    out, s = set(), sh(licenses.words(text))
    for name, t in templates.items():
        own = set(sh(licenses.words(t)))
        if not own:
            continue
        width = max(licenses.size_class(len(own)), int(len(own) / contained))
        if any(len(own & set(s[i : i + width])) / len(own) >= contained for i in range(len(s))):
            out.add(name)
    return out


def test_planted_templates_are_found():
    r, index = random.Random(5), licenses.Index(licenses.TEMPLATES)
    texts = []
    for _ in range(300):
        w = [r.choice("alpha beta gamma delta of the".split()) for _ in range(r.randrange(200))]
        for t in r.sample(list(licenses.TEMPLATES.values()), r.randrange(3)):
            own = t.split()
            for _ in range(r.randrange(3) if len(own) > 30 else 0):
                own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = own
        texts.append(" ".join(w))
    got = [{x[0] for x in f} for f in index.find_many(texts)]
    want = [brute(t, licenses.TEMPLATES) for t in texts]
    assert got == want and sum(map(len, want)) > 200


def test_places_and_containment():
    index = licenses.Index({"mit": "Released under the MIT License.", "none": "..."})
    assert index.find_many(["", None, "so: released UNDER the mit license!", "released under a mit license"]) == [[], [], [("mit", 1.0, 1, 6)], []]


def test_sample_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for r in docs.collect():
        assert got.get(r.doc_id, set()) == brute(r.text, licenses.TEMPLATES)


def test_tables(spark):
    assert licenses.scan(no_docs(spark)).count() == 0
    assert licenses.scan(odd_docs(spark), {}).count() == 0
    assert {r.license for r in licenses.scan(odd_docs(spark), {"fox": "the quick brown fox jumps over"}).collect()} == {"fox"}
