import random
import re

from tests.llm.cases import no_docs, odd_docs
from tidemill.llm import decontam


def brute_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, ids = brute_words(text), set(), set()
    for item, t in items:
        v = brute_words(t)
        m = min(13, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                ids |= {item} - {None}
    return len(w), len(hit), sorted(ids)


def spread(spans):
    return sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True))


def test_random_texts():
    r = random.Random(3)
    for _ in range(400):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 2, 5, 13, 14, 20])))) for i in range(4)]
        items.append(("9", items[0][1]))
        text = " ".join(r.choice("abcd") for _ in range(40)) + ", " + r.choice(items)[1].upper() + " é"
        n, spans, ids = decontam.search(text, decontam.searchers(items))
        assert (n, spread(spans), ids) == brute(text, items)


def test_blocks_add_up_and_odd_rows(spark):
    items = [(i, f"the lazy dog w{i}") for i in range(5)] + [(7, "quick brown fox"), (8, ""), (9, None), (None, "one two"), (7, "quick brown fox")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = [(None if i is None else str(i), t) for i, t in items]
    for size in (10, 10**6):
        got = decontam.contamination(odd_docs(spark), bench, block_bytes=size).collect()
        want = [(r.doc_id, *brute(r.text, plain)) for r in odd_docs(spark).collect()]
        assert sorted(((r.id, r.n_words, spread(r.spans), r["items"]) for r in got), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, sf_dir):
    import hashlib

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontam.query(spark, sf_dir).collect()}
    hits = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, hit, ids = brute(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(ids), hit > 0 and 20 * hit >= n)
        assert g.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        hits += hit > 0
    assert hits


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(no_docs(spark), none).count() == 0
    assert all(not r["items"] for r in decontam.contamination(odd_docs(spark), none).collect())
    docs = odd_docs(spark)
    assert decontam.keep_clean(docs, none).collect() == docs.collect()


def test_rows_go_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(5, "x alpha beta gamma"), (5, "innocent"), (None, "alpha beta gamma"), (None, "clean"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in decontam.keep_clean(docs, bench).collect()), key=str) == sorted([(5, "innocent"), (None, "clean"), (6, None)], key=str)


def test_blocks_of_equal_words_and_other_windows():
    items = [(str(i), "of the " * 9 + f"w{i}") for i in range(300)] + [("x", "of the of the")]
    found = decontam.searchers(items)
    text = "of the " * 30 + "w7 of the"
    n, spans, ids = decontam.search(text, found)
    assert (n, spread(spans), ids) == brute(text, items)
    assert decontam.search("", found) == (0, [], []) and decontam.search("of", found) == (1, [], [])
    for window in (1, 2, 3, 300):
        short = decontam.searchers([("a", "p q r p q"), ("b", "q")], window)
        n, spans, ids = decontam.search("z p q r p q z", short)
        assert spread(spans) == 5 and ids == ["a", "b"]


def test_tables_are_small():
    import tracemalloc

    r = random.Random(5)
    items = [(str(i), " ".join(f"w{r.randrange(50000)}" for _ in range(2000))) for i in range(100)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    found = decontam.searchers(items)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 20 * size and found
