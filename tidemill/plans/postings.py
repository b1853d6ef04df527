"""Queries that read pay, places, titles and prompts out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.plans.registry import query, t

@query("t24_source_blocks", r"""SELECT doc_id, md5('[' || (doc_id % 8 + 1) || '] ' || source || ' at ' || coalesce(lang, '?') || CASE WHEN doc_id % 2 = 0 THEN ' (remote)' ELSE '' END || chr(10) ||
  substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 900)) AS block FROM documents""")
def _(spark, d):
    c = t(spark, d, "documents")
    block = text.source_block(F.col("doc_id") % 8 + 1, F.col("source"), F.coalesce("lang", F.lit("?")), F.lit(None).cast("string"), F.col("doc_id") % 2 == 0, F.col("text"))
    return c.select("doc_id", F.md5(block).alias("block"))


@query("t22_fill_template", "SELECT conv_id, turn, md5(role || ' says: ' || text || ' for $5 and $who') AS prompt FROM conversations")
def _(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(text.fill(F.lit("$role says: ${text} for $$5 and $who"), {"role": F.col("role"), "text": F.col("text")})).alias("prompt"))


@query("t31_split_key", "SELECT doc_id, source, doc_id || ':x' AS source_id FROM documents")
def _(spark, d):
    key = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":x"))
    return t(spark, d, "documents").select("doc_id", text.split_key(key).alias("k")).select("doc_id", "k.source", "k.source_id")
