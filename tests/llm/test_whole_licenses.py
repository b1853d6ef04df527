"""Whole license texts, the notices near GPL-3.0, and the better of near-identical matches."""

from pathlib import Path

import pytest

from tidemill.llm import licenses

TEXTS = {p.stem: p.read_text("utf-8") for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}


@pytest.fixture(scope="module")
def index():
    return licenses.Index(licenses.registered())


def found(index, text):
    return {m[0]: m[1] for m in licenses.settled(index.find_many([text])[0])}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_the_end_of_a_text_is_found(index, name):
    own = TEXTS[name].split()
    assert name in found(index, "some words before " + " ".join(own[-len(own) // 2 :]) + " and after")


@pytest.mark.parametrize("name", sorted(licenses.FAMILY))
def test_a_notice_is_its_own_license(index, name):
    assert found(index, "x y z " + licenses.FAMILY[name] + " a b c") == {name: 1.0}


def test_gpl_3_notice_stays(index):
    assert found(index, licenses.TEMPLATES["GPL-3.0"]) == {"GPL-3.0": 1.0}


def test_query_has_the_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, TEXTS["MIT"].split("\n\n")[2]), (2, "plain words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.license) for r in licenses.query(spark, str(tmp_path)).collect()] == [(1, "MIT")]
