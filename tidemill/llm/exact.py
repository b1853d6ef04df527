"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only. A row goes on to the next level only if its group at this level may
have two or more rows; full texts are hashed for the rows that are left after the prefix. Which
groups are left is kept as a bitmap of bounded size that is broadcast, so no text and no row is
shuffled to find out: a row whose bit another group set costs one needless hash, no error.

Defined cases: null text counts as empty, and empty texts equal each other; texts of any length
are hashed whole; of equal texts the row with the smallest id stays (a null id comes after all
others, and of one id the row that stands first by row key); repeated rows are rows of one group,
of which one stays; rows are told apart by key, so repeated and null ids lose nothing; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop_rows, join_groups, keyed, release, settle, table

#: Characters of the prefix that the second level hashes.
PREFIX = 64
#: Bits of the bitmap that says which groups are left. It is kept as the words that have any set, 2^20 at most.
BITS = 1 << 26


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """The bitmap (word, bits) of the keys that two or more rows have: a row for each such key, BITS / 64 at most."""
    found = rows.groupBy(*key).count().where("count > 1").select(_slot(*key).alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))
    words = found.select(F.floor(F.col("s") / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return settle(words, "exact-shared")


def _with_bit(rows: DataFrame, bitmap: DataFrame, *key: str) -> DataFrame:
    """rows with `left`, which is true for every key of the bitmap."""
    slot = _slot(*key)
    joined = rows.withColumn("word", F.floor(slot / 64)).join(F.broadcast(bitmap), "word", "left")
    bit = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.pmod(slot, F.lit(64)).cast("int"))
    return joined.withColumn("left", bit == 1).drop("word", "bits")


def refine(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: str | None = None) -> DataFrame:
    """One row per input row: key, id, keep_id, group_size, kept.

    docs and key are what common.keyed() gives. With digest the second scan also hashes each row's full
    text into a column of that name, which the refinement does not use.
    """
    norm = normalised(F.col(text_col))
    scan = docs.select(F.col(key).alias("key"), F.col(id_col).alias("id"), norm.alias("t"))
    scan = scan.select("key", "id", F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("p"), "t")
    rows = settle(scan.drop("t", "key", "id"), "exact")
    lengths = _shared(rows, "n")
    prefixes = _shared(_with_bit(rows, lengths, "n").where("left"), "n", "p")
    # The second scan hashes the full texts of surviving groups only; nothing of it is shuffled.
    more = [digest] if digest else []
    found = _with_bit(scan, prefixes, "n", "p").select("key", "id", F.when(F.col("left"), F.sha2("t", 256)).alias("sha"), *[F.sha2("t", 256).alias(c) for c in more])
    found = settle(found, "exact-full")
    release(rows, lengths, prefixes)
    first = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "key")).alias("first")
    groups = settle(found.where("sha is not null").groupBy("sha").agg(F.count("*").alias("c"), first).where("c > 1"), "exact-groups")
    columns = ("key", "id", F.coalesce(F.col("first.id"), "id").alias("keep_id"), F.coalesce("c", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("first.key") == F.col("key"), F.lit(True)).alias("kept"), *more)
    alone = found.where("sha is null").select("key", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    return join_groups(found.where("sha is not null"), groups, "sha", "c").select(*columns).unionByName(alone)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were."""
    rows, key = keyed(docs)
    return drop_rows(rows, key, refine(rows, key, id_col, text_col).where("not kept").select("key"))


def query(spark, sf_dir: str) -> DataFrame:
    """The groups, and beside them each row's digest, which the refinement has no need of."""
    docs, key = keyed(table(spark, sf_dir, "documents"))
    found = refine(docs, key, digest="text_sha256")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
