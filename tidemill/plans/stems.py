"""The English stemmer in SQL, step by step over the distinct words of a table, to compare searches with.

It shares the word and suffix lists of `functions.english`, which are the algorithm's own, and nothing
else: regions are found by patterns, and each step is a projection.
"""

from __future__ import annotations

from tidemill.functions import english as en

_V = "[aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _cut(n: int, c: str = "w") -> str:
    return f"substr({c}, 1, length({c}) - {n})"


def _region(c: str, start: str) -> str:
    """Where the part behind the first consonant after a vowel begins."""
    rest = f"substr({c}, {start} + 1)"
    return f"CASE WHEN regexp_matches({rest}, '{_V}[^aeiouy]') THEN {start} + length(regexp_extract({rest}, '^.*?{_V}[^aeiouy]')) ELSE length({c}) END"


def _suffixes(rules: dict[str, tuple[str, str]]) -> str:
    """The longest suffix that a word ends with decides: (condition, result) of each."""
    return "CASE " + " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {cond} THEN {out} ELSE w END" for s, (cond, out) in sorted(rules.items(), key=lambda r: -len(r[0]))) + " ELSE w END"


def _plain(table: dict[str, str], region: str) -> dict[str, tuple[str, str]]:
    return {s: (f"length(w) - {len(s)} >= {region}", f"{_cut(len(s))} || '{to}'") for s, to in table.items()}


def stems(source: str) -> str:
    """CTEs that end with stems(term, stem) for every term of a table."""
    exceptions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in en.EXCEPTIONS.items())
    prefix = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in en.LONG_PREFIXES)
    fixed = f"CASE WHEN regexp_matches(m, '(at|bl|iz)$') THEN m || 'e' WHEN regexp_matches(m, '({'|'.join(en.DOUBLES)})$') THEN {_cut(1, 'm')} WHEN length(m) <= r1 AND regexp_matches(m, '{_SHORT}') THEN m || 'e' ELSE m END"
    two = _plain(en.STEP_2, "r1") | {"ogi": ("length(w) - 3 >= r1 AND ends_with(w, 'logi')", _cut(1)), "li": (f"length(w) - 2 >= r1 AND regexp_matches(w, '[{en.LI_ENDINGS}]li$')", _cut(2))}
    three = _plain(en.STEP_3, "r1") | {"ative": ("length(w) - 5 >= r1 AND length(w) - 5 >= r2", _cut(5))}
    four = _plain(dict.fromkeys(en.STEP_4, ""), "r2") | {"ion": ("length(w) - 3 >= r2 AND regexp_matches(w, '[st]ion$')", _cut(3))}
    return f"""x0 AS (SELECT DISTINCT term FROM {source}),
  x1 AS (SELECT term, regexp_replace(term, '(^|{_V})y', '\\1Y', 'g') AS w FROM x0 WHERE length(term) > 2 AND term NOT IN {_in(en.EXCEPTIONS)}),
  x2 AS (SELECT *, CASE {prefix} ELSE {_region('w', '0')} END AS r1 FROM x1), x3 AS (SELECT *, {_region('w', 'r1')} AS r2 FROM x2),
  x4 AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN {_cut(2)} WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END
    WHEN ends_with(w, 's') AND NOT regexp_matches(w, '[us]s$') AND regexp_matches({_cut(2)}, '{_V}') THEN {_cut(1)} ELSE w END AS w FROM x3),
  x5 AS (SELECT *, w IN {_in(en.KEPT_AFTER_1A)} AS kept, regexp_extract(w, '^(.*?)(ingly|edly|ing|ed)$', 1) AS m, regexp_matches(w, '(ingly|edly|ing|ed)$') AS past, regexp_extract(w, '(eedly|eed)$') AS eed FROM x4),
  x6 AS (SELECT term, r1, r2, kept, CASE WHEN kept THEN w WHEN eed <> '' THEN CASE WHEN length(w) - length(eed) >= r1 THEN substr(w, 1, length(w) - length(eed)) || 'ee' ELSE w END
    WHEN past AND regexp_matches(m, '{_V}') THEN {fixed} ELSE w END AS w FROM x5),
  x7 AS (SELECT term, r1, r2, kept, CASE WHEN NOT kept AND regexp_matches(w, '.[^aeiouy][yY]$') THEN {_cut(1)} || 'i' ELSE w END AS w FROM x6),
  x8 AS (SELECT term, r1, r2, kept, CASE WHEN kept THEN w ELSE {_suffixes(two)} END AS w FROM x7), x9 AS (SELECT term, r1, r2, kept, CASE WHEN kept THEN w ELSE {_suffixes(three)} END AS w FROM x8),
  xa AS (SELECT term, r1, r2, kept, CASE WHEN kept THEN w ELSE {_suffixes(four)} END AS w FROM x9),
  xb AS (SELECT term, CASE WHEN kept THEN w WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches({_cut(1)}, '{_SHORT}') THEN {_cut(1)} ELSE w END
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END AS w FROM xa),
  stems AS (SELECT term, replace(w, 'Y', 'y') AS stem FROM xb UNION ALL SELECT term, CASE term {exceptions} ELSE term END FROM x0 WHERE length(term) <= 2 OR term IN {_in(en.EXCEPTIONS)})"""


STOP_WORDS = _in(sorted(en.STOP_WORDS))
