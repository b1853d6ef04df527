"""Queries of the pay grammar: texts written out from orders, and what they were written from.

The SQL never reads the text. It has the numbers, units and words that the text was made of, and
says what a reader should find in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import money
from tidemill.plans.registry import query, t

#: k is the order's key, w its price in whole units, a and b two figures of which b is larger.
_FROM = {"k": "o_orderkey", "w": "CAST(floor(o_totalprice) AS BIGINT) + 1000", "a": "o_orderkey % 300 + 100", "b": "o_orderkey % 300 + 101 + o_orderkey % 50", "s": "o_orderkey % 9 + 1"}
_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _FROM.items())


def _cases(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def pay(name: str, key: str, forms: list[tuple[str, str, str, str, str]]) -> None:
    """Registers a query of forms (text, low, high, period, currency), dealt by key modulo their number."""
    raw, low, high, period, currency = (_cases(f"({key}) % {len(forms)}", [f[i] for f in forms]) for i in range(5))
    sql = f"WITH o AS (SELECT {_COLUMNS} FROM orders) SELECT k, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, {period} AS period, {currency} AS currency FROM o"

    @query(name, sql)
    def _(spark, d):
        o = t(spark, d, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _FROM.items()])
        p = money.with_pay(o.select("k", F.expr(raw).alias("raw")), "raw", "p")
        return p.select("k", F.col("p.min").alias("low"), F.col("p.max").alias("high"), "p.period", "p.currency")


_NONE = ("NULL", "NULL", "NULL", "NULL")

pay("m1_pay", "k", [
    ("'$' || w || ' - $' || (w + 500) || ' per month'", "w", "w + 500", "'month'", "'USD'"),
    ("'Up to £' || w", "NULL", "w", "'year'", "'GBP'"),
    ("''", *_NONE),
    ("'Great benefits, no figures'", *_NONE),
    ("CAST(NULL AS STRING)", *_NONE),
])

pay("m2_experience", "k", [
    ("s || '-' || (s + 2) || ' years, $' || w", "w", "w", "'year'", "'USD'"),
    ("s || '+ yrs; €' || w || ' - €' || (w + 9)", "w", "w + 9", "'year'", "'EUR'"),
    ("s || ' to ' || (s + 3) || ' years experience'", *_NONE),
    ("'Pay ' || w || ', ' || s || '.5 years'", "w", "w", "'year'", "NULL"),
    ("'1 year, ' || s || ' LPA'", "s * 100000", "s * 100000", "'year'", "'INR'"),
])

pay("m3_indian_units", "k", [
    ("s || '-' || (s + 4) || ' LPA'", "s * 100000", "(s + 4) * 100000", "'year'", "'INR'"),
    ("'₹' || s || '.5 Cr'", "s * 10000000 + 5000000", "s * 10000000 + 5000000", "'year'", "'INR'"),
    ("s || ' - ' || (s + 1) || ' lakhs per annum'", "s * 100000", "(s + 1) * 100000", "'year'", "'INR'"),
    ("s || ' L - ' || (s + 2) || ' L p.a.'", "s * 100000", "(s + 2) * 100000", "'year'", "'INR'"),
    ("s || 'L'", "s", "s", "NULL", "NULL"),
    ("'₹' || s || ' lac per month'", "s * 100000", "s * 100000", "'month'", "'INR'"),
    ("(s + 50) || ' lakh - ' || s || ' crore'", "(s + 50) * 100000", "s * 10000000", "'year'", "'INR'"),
])

pay("m4_unstated", "k", [
    ("'Competitive, ' || s || ' rounds'", *_NONE),
    ("'Negotiable around ' || w", "w", "w", "'year'", "NULL"),
    ("'DOE, ' || a || 'k'", "a * 1000", "a * 1000", "'year'", "NULL"),
    ("'market rate for ' || s || ' people'", *_NONE),
    ("'Competitive: ' || s || ' LPA'", "s * 100000", "s * 100000", "'year'", "'INR'"),
    ("'TBD ' || s", *_NONE),
])

pay("m5_plus_tail", "k", [
    ("'$' || w || ' + ' || s || '% equity'", "w", "w", "'year'", "'USD'"),
    ("'$' || w || ' plus ' || (w + 5) || ' bonus'", "w", "w", "'year'", "'USD'"),
    ("'$' || w || '+'", "w", "NULL", "'year'", "'USD'"),
    ("'£' || w || ' - £' || (w + 7) || ' + $' || s", "w", "w + 7", "'year'", "'USD'"),
])

pay("m6_currency", "k", [
    (f"'{before}' || w || '{after}'", "w", "w", "'year'", f"'{code}'" if code else "NULL")
    for before, after, code in (("AU$", "", "AUD"), ("CA$", "", "CAD"), ("C$", "", "CAD"), ("A$", "", "AUD"), ("$", " CAD", "CAD"), ("€", "", "EUR"), ("₹", "", "INR"), ("Rs. ", "", "INR"), ("", " CHF", "CHF"), ("", " sek", "SEK"), ("¥", "", "JPY"), ("", "", None))
])

pay("m7_period", "k", [
    (f"'$' || a || '{said}'", "a", "a", f"'{period}'" if period else "NULL", "'USD'")
    for said, period in ((" per hour", "hour"), ("/hr", "hour"), (" / hour", "hour"), (" an hour", "hour"), (" a day", "day"), (" daily", "day"), ("/wk", "week"), (" weekly", "week"), (" per month", "month"), (" p.m.", "month"), ("/mo", "month"), (" p.a.", "year"), (" per annum", "year"), (" annually", "year"), (" / yr", "year"), ("", None))
])

pay("m8_range", "k", [
    ("a || 'k-' || b || 'k'", "a * 1000", "b * 1000", "'year'", "NULL"),
    ("a || '-' || b || 'K USD'", "a * 1000", "b * 1000", "'year'", "'USD'"),
    ("'$' || a || ',000 to $' || b || ',000'", "a * 1000", "b * 1000", "'year'", "'USD'"),
    ("'$' || b || ',000 - $' || a || ',000'", "a * 1000", "b * 1000", "'year'", "'USD'"),
    ("a || ' – ' || b", "a", "b", "NULL", "NULL"),
    ("'Up to ' || a || '-' || b || 'k'", "NULL", "a", "NULL", "NULL"),
    ("a || ' and ' || b || ' per day'", "a", "b", "'day'", "NULL"),
    ("'$' || a || ',000 -- ' || b", "a * 1000", "b * 1000", "'year'", "'USD'"),
])

pay("m9_bounds", "k", [
    ("'From $' || w", "w", "NULL", "'year'", "'USD'"),
    ("'starting at ' || w", "w", "NULL", "'year'", "NULL"),
    ("'upwards of €' || w", "w", "NULL", "'year'", "'EUR'"),
    ("'up to ' || w || ' GBP'", "NULL", "w", "'year'", "'GBP'"),
    ("'upto ' || s || ' LPA'", "NULL", "s * 100000", "'year'", "'INR'"),
    ("'$' || w", "w", "w", "'year'", "'USD'"),
])

pay("m10_inferred_period", "k", [
    ("CAST(k % 2000 AS STRING)", "k % 2000", "k % 2000", "CASE WHEN k % 2000 >= 1000 THEN 'year' END", "NULL"),
    ("'€' || (k % 900 + 50) || ' - €' || (k % 900 + 95)", "k % 900 + 50", "k % 900 + 95", "NULL", "'EUR'"),
])

pay("m11_numbers", "k", [
    ("a || 'k'", "a * 1000", "a * 1000", "'year'", "NULL"),
    ("a || ' K'", "a * 1000", "a * 1000", "'year'", "NULL"),
    ("a || ',500'", "a * 1000 + 500", "a * 1000 + 500", "'year'", "NULL"),
    ("a || ' 250'", "a * 1000 + 250", "a * 1000 + 250", "'year'", "NULL"),
    ("a || '.5k'", "a * 1000 + 500", "a * 1000 + 500", "'year'", "NULL"),
    ("'₹' || s || ',25,000'", "s * 100000 + 25000", "s * 100000 + 25000", "'year'", "'INR'"),
])
