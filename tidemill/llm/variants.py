"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so anagrams share a key, and
words that differ by one letter have keys that differ by that letter's power, or by the difference of
two. Each word gives its key less each of its letters: two words with an equal one can differ by an
exchanged letter, and a word whose own key equals another's lessened key can lack one letter of it. One
join on these keys finds both; the order of letters is verified on the pairs.

Words within one edit agree before or behind their middle, so each key is joined twice, with a hash of
the first and of the second half. Anagrams are many only in theory, but then a bucket holds those alone
that have half of their letters in the same order, and no link is lost.

Defined cases: null text has no words; a null id changes no word; runs are maximal, so very long texts
and runs are read whole; only A-Z are lower-cased; of near words equally frequent the smallest in
code-point order is the form; repeated rows count each time; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, release, scratch, settle, table

#: Code points and occurrences that a word has at least, and how much more frequent a form must be.
MIN_LETTERS, MIN_COUNT, FORM_TIMES = 7, 2, 10
#: One in so many pairs of document and word loses a letter in the query.
SLIPS = 31
#: Distinct words that a task counts before it hands them on.
_COUNTED = 300_000
#: Sums of powers are kept below this prime, far above any two powers, so that no word is too long.
_PRIME = (1 << 61) - 1

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def slipped(start: int, run: str) -> str:
    """The run, less one letter where the checksum begun with start asks for it."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIPS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slips: bool = False) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    slips takes the words as the query does, some without one letter, by document and word.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_letters)  # a shorter run cannot become long enough

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        total: Counter[str] = Counter()
        for i, text in rows:
            own = Counter(runs.findall(text or ""))
            if slips and i is not None:
                start = zlib.crc32(f"{i}:".encode())
                for w, n in own.items():
                    if len(w := slipped(start, lowered(w))) >= min_letters:
                        total[w] += n
            else:
                for w, n in own.items():
                    total[lowered(w)] += n
            if len(total) >= _COUNTED:
                yield from total.items()
                total = Counter()
        yield from total.items()

    counted = map_rows(docs, [id_col, text_col], run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def anagram_key(word: Column) -> Column:
    """The sum of the letters' powers."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: (s + power(c)) % _PRIME)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def _keys(words: DataFrame) -> DataFrame:
    """(k, side, half, word, n, gone): a word's key less each letter, and whole where `gone` is null, by both halves."""
    size = F.length("word")

    def halves(cut: Column, rest: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), cut).alias("h")), F.struct(F.lit(1).alias("side"), F.substr("word", rest + 1).alias("h")))

    keyed = words.withColumn("key", anagram_key(F.col("word"))).withColumn("m", F.floor((size - 1) / 2).cast("int")).withColumn("w", F.floor(size / 2).cast("int"))
    less = F.transform(F.array_distinct(F.split("word", "")), lambda c: F.struct(F.pmod(F.col("key") - power(c), F.lit(_PRIME)).alias("k"), c.alias("gone")))
    whole = F.array(F.struct(F.col("key").alias("k"), F.lit(None).cast("string").alias("gone")))
    # A word less one letter is as long as the word it may lack that letter of, so both are cut alike.
    lessened = keyed.select("word", "n", (size - 1).alias("size"), F.explode(less).alias("x"), halves(F.col("m"), F.col("m") + 1).alias("y"))
    entire = keyed.select("word", "n", size.alias("size"), F.explode(whole).alias("x"), halves(F.col("w"), F.col("w")).alias("y"))
    both = lessened.unionByName(entire).select("word", "n", "size", "x", F.explode("y").alias("y"))
    return both.select(F.col("x.k").alias("k"), F.col("y.side").alias("side"), F.xxhash64("size", "y.h").alias("half"), "word", "n", F.col("x.gone").alias("gone"))


def links(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words(word, n) within one edit, once."""
    rows = _keys(words)
    a, b = rows.alias("a"), rows.alias("b")
    exchanged = (F.col("a.gone") < F.col("b.gone")) & (F.length("a.word") == F.length("b.word"))
    inserted = F.col("a.gone").isNull() & F.col("b.gone").isNotNull() & (F.length("a.word") + 1 == F.length("b.word"))
    met = a.join(b, [F.col("a.k") == F.col("b.k"), F.col("a.side") == F.col("b.side"), F.col("a.half") == F.col("b.half"), F.coalesce(exchanged, F.lit(False)) | inserted])
    # What agrees before the middle was found there; behind it, only the others are new.
    cut = F.floor(F.when(F.col("a.gone").isNull(), F.length("a.word")).otherwise(F.length("a.word") - 1) / 2).cast("int")
    new = (F.col("a.side") == 0) | (F.substr("a.word", F.lit(1), cut) != F.substr("b.word", F.lit(1), cut))
    pairs = met.where(new & (F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def forms(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) for words(word, n): the most frequent near word, if it is that much more frequent."""
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = links(words).select(F.explode(ends).alias("e")).select("e.*").withColumn("n", F.lit(None).cast("long"))
    own = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near"))).alias("best")
    found = near.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    strong = -F.col("best.m") >= times * F.col("n")
    return found.select("word", "n", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) for the words of forms() that have a form: the last word of the chain of forms.

    A form is so much more frequent that chains are short; each round doubles how far one sees.
    """
    now = settle(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = further.select("word", "root")
        now._settled_at = further._settled_at
        if further.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n)."""
    with scratch() as keep:
        found = keep(settle(forms(settle(words, "words"), times), "forms"))
        last = keep(roots(found))
    out = found.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents"), slips=True))


#: Words within one edit have a letter whose removal, at the same place or in one of them, makes them equal.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lower_runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM runs WHERE length(run) >= 7 GROUP BY ALL
), marked AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || w, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END))),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h
  FROM lower_runs, bits
), counted AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM marked GROUP BY 1
), words AS MATERIALIZED (SELECT word, n FROM counted WHERE length(word) >= 7 AND n >= 2),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS m, min(struct_pack(k := -near_n, near := near)).near AS near FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.near END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e ON e.word = f.word
"""
