import random

import numpy as np
import pytest
import xxhash

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import common, simhash
from tidemill.llm.common import keyed
from tidemill.llm.graph import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, radius=4):
    """fps: list of (id, fp); the smallest id reachable for each row."""
    n = len(fps)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= radius:
                up[find(i)] = find(j)
    low = {}
    for i in range(n):
        if fps[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 62), fps[i][0])
    return [low.get(find(i)) for i in range(n)]


def test_fingerprint_equals_brute_force():
    r = random.Random(1)
    for _ in range(50):
        t = " ".join(r.choice(["Ab", "cd", "É", "x,", "The", "99"]) for _ in range(r.randrange(0, 30)))
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def check(spark, docs, rows):
    found = simhash.near_duplicates(*keyed(docs)).collect()
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in found), key=str)
    assert sorted((r.id for r in found if r.kept), key=str) == sorted(set(r.component_id for r in found), key=str)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert got == want


def test_odd_rows(spark):
    check(spark, odd_docs(spark), odd_rows())


def test_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert simhash.near_duplicates(*keyed(no_docs(spark))).count() == 0
    docs = no_docs(spark)
    assert simhash.keep_representatives(docs).columns == docs.columns


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_repeated_null_and_text_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(common, "HOT_GROUPS", 1)
    rows = [("x1", "a"), ("x5", "a"), ("x5", "b"), (None, "b"), (None, "c"), ("x9", "c"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = simhash.keep_representatives(docs).collect()
    assert sorted((r.doc_id or "", r.text or "") for r in kept) == [("", ""), ("x1", "a"), ("x5", "b"), ("x9", "c")]


@pytest.mark.parametrize("n", [0, 1 << 20, 1 << 28, 1 << 33, 1 << 36])
def test_bands_lose_no_link(n):
    widths = simhash.bands(n)
    assert sum(widths) == 64 and len(widths) > simhash.RADIUS
    assert len(simhash.bands(n)) >= len(simhash.bands(n // 100))


def ball(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block_rows", [8192, 40])
@pytest.mark.parametrize("n", [400, 1 << 33])
def test_links_join_all_near_pairs_even_in_split_blocks(spark, block_rows, n):
    fps = ball(400, 3)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), n, block_rows=block_rows)
    for a, b in edges.collect():
        assert a != b
    root = {r.node % (1 << 64): r.root for r in components(edges).collect()}
    want = brute_components(list(enumerate(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            assert (want[i] == want[j]) == (root.get(a, a) == root.get(fps[j], fps[j]))


def test_link_large_equals_brute_force():
    fps = np.array(ball(600, 5), np.uint64)
    ids = {int(f): i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in simhash.link_large(fps, 4):
        up[find(ids[a % (1 << 64)])] = find(ids[b % (1 << 64)])
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert len({find(i) for i in range(len(fps))}) == len(set(want))
    assert all((find(i) == find(0)) == (want[i] == want[0]) for i in range(len(fps)))


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
