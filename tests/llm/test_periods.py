import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.cases import LONG, no_docs, odd_docs, odd_rows
from tidemill.llm import periods, queries


def brute(words, min_length=6, min_exponent=4):
    """All runs, by every period and every stretch of equals at its distance."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sequence(r):
    n, k = r.randrange(60), r.choice([1, 2, 2, 3, 5])
    s = [r.randrange(k) for _ in range(n)]
    if r.random() < 0.4:
        p = r.randrange(1, 8)
        s = [s[i % p] if i % p < n else 0 for i in range(n)]
        if n and r.random() < 0.5:
            s[r.randrange(n)] = 9
    return s + s[: r.randrange(10)] + s if r.random() < 0.3 else s


@pytest.mark.parametrize(("min_length", "min_exponent"), [(2, 2), (6, 4), (1, 3), (9, 2)])
def test_all_runs_of_random_sequences(min_length, min_exponent):
    r = random.Random(min_length)
    for _ in range(400):
        seqs = [sequence(r) for _ in range(r.randrange(6))]
        got = periods.all_runs([periods.numbered([b"%d" % x for x in s]) for s in seqs], min_length, min_exponent)
        assert got == [brute(s, min_length, min_exponent) for s in seqs], seqs


def test_arrays_behind_the_runs():
    """Suffixes, LCP, previous factors and blocks against their definitions."""
    r = random.Random(6)
    for _ in range(60):
        s = [x + 1 for x in sequence(r)] + [0]
        n = len(s)
        sym = np.unique(np.array(s), return_inverse=True)[1]
        suffixes = periods.Suffixes(sym)
        order = sorted(range(n), key=lambda i: s[i:])
        assert suffixes.sa.tolist() == order
        same = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
        assert suffixes.lcp().tolist() == [0] + [same(a, b) for a, b in zip(order, order[1:])]
        length, place = periods.previous_factors(suffixes.sa, suffixes.lcp())
        want = [max((same(j, i) for j in range(i)), default=0) for i in range(n)]
        assert length.tolist() == want
        assert all(place[i] < i and same(int(place[i]), i) == want[i] for i in range(n) if want[i])
        at, starts = 0, []
        while at < n:
            starts.append(at)
            at += max(1, want[at])
        assert periods.blocks(length).tolist() == starts


def test_one_search_in_several_chunks_of_borders(monkeypatch):
    r = random.Random(7)
    seqs = [periods.numbered([b"%d" % x for x in sequence(r)]) for _ in range(50)]
    whole = periods.all_runs(seqs, 2, 2)
    monkeypatch.setattr(periods, "_PAIRS", 7)
    assert periods.all_runs(seqs, 2, 2) == whole


def test_exponents_below_two_raise():
    with pytest.raises(ValueError):
        periods.all_runs([], 2, 1)


def wanted(doc_id, text):
    """The contract, word by word."""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text or "") if w]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 4000}  # brute force grows with the square
    assert len(short) > 0.9 * len(rows) and got.count() == len(rows)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id in short) == sorted(wanted(i, t) for i, t in short.items())


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows() if r[1] != LONG]
    docs = odd_docs(spark)
    got = periods.summaries(docs.where(docs.text != LONG).unionByName(docs.where("text is null")), change=periods.repeated)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((wanted(*r) for r in rows), key=str)
    runs = periods.find(docs.where("doc_id = 6")).collect()
    assert [tuple(r) for r in runs] == [(6, 0, 12000, 3)]
    assert periods.collapse(docs.where("doc_id = 6")).first().text == "lorem ipsum dolor"
    for f in (periods.find, periods.collapse, periods.summaries):
        assert f(no_docs(spark)).count() == 0


def test_ties_and_overlapping_runs(spark):
    text = "a a a a a a b b b b b b"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x y " * 4 + "x x x x x x x")], "doc_id long, text string")
    got = periods.summaries(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got[:2]] == [(1, 2, 0, 6, 1, 6000)] * 2
    assert tuple(got[2])[:6] == (2, 2, 8, 7, 1, 7000)
    assert sorted(r.text for r in periods.collapse(docs).collect()) == ["a b", "a b", "x y"]
