import itertools
import random
import re
import zlib
from collections import Counter

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import variants


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    rows = {}
    for w, n in counts.items():
        close = sorted(((-m, v) for v, m in counts.items() if near(w, v)))
        form = close[0][1] if close and -close[0][0] >= 10 * n else None
        rows[w] = (form, n, len(close), counts[form] if form else None)
    out = set()
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, m))
    return out


def contract_words(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_random_vocabulary(spark):
    """Few letters and edited words, so that links, chains, anagrams and ties are many."""
    r, words = random.Random(1), {}
    for _ in range(60):
        w = "".join(r.choice("abcé") for _ in range(r.randrange(1, 9)))
        for k in range(5):
            words[w] = r.choice([2, 2, 3, 20, 25, 250, 3000])
            i = r.randrange(len(w) + 1)
            w = w[:i] + r.choice(["", "b", "é", "ÿ"]) + w[i + r.randrange(2) :] or "a"
    got = {tuple(x) for x in variants.grouped(of(spark, words)).collect()}
    assert got == brute(words)
    assert sum(x[1] is not None for x in got) > 30


def test_each_link_comes_once(spark):
    words = {"".join(p): 2 for p in itertools.permutations("abcdef")} | {"".join(p) + "x": 2 for p in itertools.permutations("abcde")}
    got = [tuple(sorted((x.a, x.b))) for x in variants.links(of(spark, words)).collect()]
    want = [tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p)]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want) and want


def test_chains_lead_to_the_last_form(spark):
    words = {"abcdefgh": 3, "abcdefghi": 30, "abcdefghij": 300, "abcdefghijk": 3000, "abcdefghijkl": 30000, "zbcdefg": 5, "ybcdefg": 5}
    got = {x.word: (x.form, x.root) for x in variants.grouped(of(spark, words)).collect()}
    assert got["abcdefgh"] == ("abcdefghi", "abcdefghijkl") and got["abcdefghijkl"] == (None, "abcdefghijkl")
    assert got["zbcdefg"] == (None, "zbcdefg")


def test_odd_rows_and_long_runs(spark):
    rows = [r[:2] for r in odd_rows()] + [(11, "Lorem ipsum dolores DOLORES dolores Üblichen üblichen ü" + "É" * 300), (12, "É" * 301), (12, "É" * 301), (13, "É" * 301 + " É" + "É" * 299 + "\u0100"), (None, "dolores")]
    docs = odd_docs(spark).select("doc_id", "text", "key", "word").unionByName(spark.createDataFrame(rows[len(odd_rows()) :], "doc_id long, text string"), allowMissingColumns=True)
    counts = contract_words(rows)
    assert max(map(len, counts)) > 299
    got = variants.grouped(variants.vocabulary(docs, slips=True))
    assert {tuple(x) for x in got.collect()} == brute(counts)
    assert variants.grouped(variants.vocabulary(no_docs(spark))).count() == 0


def test_words_of_the_whole_table(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = contract_words([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in variants.vocabulary(docs, slips=True).collect()} == want


def test_keys_of_very_long_words_stay_in_range(spark):
    words = {"ÿ" * 20_000: 2, "ÿ" * 20_001: 20}
    got = {x.n: (x.form_n, x.n_near) for x in variants.grouped(of(spark, words)).collect()}
    assert got == {2: (20, 1), 20: (None, 1)}
