import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import bpe, tokencounts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts(library):
    enc, r = bpe.encoder(), random.Random(2)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b", "'s", "'", "It's", "É", "漢字", "\x1c", "\x85", "　", "１２", "9", "!", "…", "<|endoftext|>", "😀", "thth", "é", "ing", "\xa0", "\r\n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids, repr(t)
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_broken_ids_decode_as_the_library_does(library):
    enc, r = bpe.encoder(), random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(8))]
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_sample_and_odd_rows(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd_docs(spark), odd_rows())):
        want = []
        for r in rows:
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trips(df).collect()), key=str) == sorted(want, key=str)


def test_encode_decode_tables(spark):
    docs = odd_docs(spark)
    back = bpe.decode(bpe.encode(docs))
    assert sorted(back.collect(), key=str) == sorted([(r[0], r[1] or "") for r in odd_rows()], key=str)
    assert bpe.round_trips(no_docs(spark)).count() == 0


def test_token_counts(spark, library):
    lengths = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows())
    sums = tokencounts.suffix_sums(tokencounts.histogram(odd_docs(spark))).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_ge == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.docs_le_share == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
    for limit in (0, 1, 5, 20, 700, 10**6):
        assert tokencounts.total_under(sums, limit) == sum(min(x, limit) for x in lengths)
    for q in (0.01, 0.25, 0.5, 0.9, 1.0):
        assert tokencounts.quantile(sums, q) == next(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths))
    assert tokencounts.suffix_sums(tokencounts.histogram(no_docs(spark))).count() == 0


def test_token_counts_of_the_table_equal_the_library(spark, sf_dir, library):
    lengths = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = {r.n_tokens: r for r in tokencounts.query(spark, sf_dir).collect()}
    assert {n: r.n_docs for n, r in rows.items()} == {n: lengths.count(n) for n in lengths}
    for n, r in rows.items():
        assert (r.docs_ge, r.tokens_ge) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.tokens_total == sum(lengths)
    limits = [0, 1, 7, 100, 1024, 10**9]
    hist = tokencounts.histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = tokencounts.at_limits(hist, limits).orderBy("limit").collect()
    assert [(r.limit, r.docs, r.tokens, r.docs_cut, r.tokens_kept) for r in got] == [(c, len(lengths), sum(lengths), sum(x > c for x in lengths), sum(min(x, c) for x in lengths)) for c in limits]
    none = tokencounts.at_limits(hist.limit(0), [5]).first()
    assert (none.docs, none.tokens, none.docs_cut, none.tokens_kept) == (0, 0, 0, 0)
