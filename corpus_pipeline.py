"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE.

Defined cases: rows are kept or dropped by row, never by doc_id, so repeated and null ids lose
nothing; null, empty and letterless texts are `und` and go in the first stage; very long texts are
read whole by every stage; of equal texts and of near copies the row with the smallest doc_id
stays, and of one doc_id the row that stands first; an empty table gives an empty table; further
columns of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, decontam, exact, langid, simhash
from tidemill.llm.common import release, scratch, settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; what is `und` or of no main language goes."""
    return langid.keep_identified(docs, langid.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text."""
    return bpe.round_trips(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe_round_trip", encode),
]

#: SQL cannot express the language model nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            before, docs = docs, keep(settle(stage(spark, docs, sf_dir), name))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
