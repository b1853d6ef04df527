import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


PARTS = [" ", "  ", "\n", "\t", "a", "b", "It's", "É", "漢字", "\x1c", "\x85", "　", "9", "!", "…", "<s>", "<unk>", "😀", "thth", "é", "ing", "\xa0", "▁", "over", "the", "register", "\x00", "aaaa", " " * 17, " " * 40]


def test_random_texts(library):
    model, r = pieces.pieces(), random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice(PARTS) for _ in range(r.randrange(12)))
        ids = library.encode(t)
        assert model.encode(t) == ids, repr(t)
        assert model.decode(ids) == library.decode(ids)


def test_pieces_run_together(library):
    """Words whose merges cut into one another, where the order of merges shows."""
    model, r = pieces.pieces(), random.Random(3)
    known = [library.id_to_piece(i).replace("▁", "") for i in range(300, 32000)]
    for n in [40] * 800 + [4000]:
        t = "".join(r.choice(known) for _ in range(r.randrange(1, n)))
        assert model.encode(t) == library.encode(t), repr(t)


@pytest.mark.parametrize("text", [" " * 100_000, " " * 99_999 + "x", "a" * 50_000, "over" * 20_000, "漢字" * 9_000 + " x", "word " * 30_000], ids=lambda t: repr(t[:6]))
def test_very_long_texts(library, text):
    assert pieces.pieces().encode(text) == library.encode(text)


def test_any_ids_decode_as_the_library_does(library):
    model, r = pieces.pieces(), random.Random(4)
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randrange(8))]
        assert model.decode(ids) == library.decode(ids), ids


def wanted(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_table_and_odd_rows(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op11_sentencepiece_round_trip"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == wanted(library, rows)
    assert sorted(map(tuple, pieces.round_trips(odd_docs(spark)).collect()), key=str) == wanted(library, [r[:2] for r in odd_rows()])


def test_encode_decode_tables(spark):
    docs = odd_docs(spark)
    back = pieces.decode(pieces.encode(docs))
    assert sorted(back.collect(), key=str) == sorted([(r[0], r[1] or "") for r in odd_rows()], key=str)
    assert pieces.round_trips(no_docs(spark)).count() == 0


def test_words_leave_the_cache_and_come_back():
    model = pieces.Pieces(pieces.default_path())
    first = model.packed_many(["some words here", "x" * 100])
    for _ in range(2):
        model.old, model.young = model.young, {}
        assert model.packed_many(["some words here", "x" * 100]) == first
    assert "x" * 100 not in model.young and model.decimals(np.array([7, 31999])) == b"7,31999" and model.decimals(np.array([], int)) == b""
