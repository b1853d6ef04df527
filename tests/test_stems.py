"""The stemmer against its steps in SQL, over words made of stems and suffixes."""

import duckdb

from tidemill.functions import english
from tidemill.plans import stems

PARTS = ("", "gener", "commun", "arsen", "hop", "hopp", "agre", "conf", "y", "say", "beaut", "skat", "luxuri", "logi", "controll", "fee", "ti", "x", "sky", "inn", "proc", "b")
ENDS = ("", "s", "es", "ies", "ied", "sses", "us", "ed", "eed", "eedly", "ing", "ingly", "edly", "y", "ly", "li", "ization", "ational", "fulness", "ogi", "logy", "ative", "ness", "ement", "ion", "tion", "sion", "e", "le", "ll", "ingly", "ousness", "alize", "ical", "er", "able")


def test_stems_equal_sql():
    words = sorted({a + b for a in PARTS for b in ENDS} | set(english.EXCEPTIONS) | set(english.KEPT_AFTER_1A) - {""})
    con = duckdb.connect()
    con.execute("CREATE TABLE s AS SELECT unnest(?) AS term", [[w for w in words if w]])
    got = dict(con.sql("WITH " + stems.stems("s") + " SELECT term, stem FROM stems").fetchall())
    assert got == {w: english.stem(w) for w in words if w}
