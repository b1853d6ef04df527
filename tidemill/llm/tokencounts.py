"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals,
quantiles and totals under any context limit without touching the documents again. The sums are
taken inside runs of RUN lengths, plus the totals of longer runs, so no task sees all lengths.

Between two lengths that occur nothing changes but the cut itself, so the rows of the lengths that
occur answer every context limit; `at_limits` reads any limits off the histogram in one pass.

Defined cases: null counts as empty, and empty texts have length 0; texts of any length are encoded
whole; documents of equal length, repeated rows among them, count each; a limit above all lengths
cuts nothing; an empty table gives an empty histogram and totals of 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe import encoded_rows, encoder
from tidemill.llm.common import map_rows, settle, table

RUN = 256


def histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs), one row per encoded length."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc, counts = encoder(path), {}
        for _, packed in encoded_rows(enc, ((None, text) for (text,) in rows)):
            n = len(packed) // 4
            counts[n] = counts.get(n, 0) + 1
        yield from counts.items()

    partial = map_rows(docs, [text_col], run, "n_tokens long, n long")
    return partial.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens at or above it, and what a limit of it keeps.

    docs_ge, tokens_ge: documents of at least this length and their tokens. truncated_total:
    tokens of all documents when each is cut at this length. docs_le_share: share of documents
    of at most this length, which is its quantile.
    """
    h = settle(hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / RUN).alias("run")), "lengths")
    runs = h.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # Runs are grouped again, so the one ordered task reads a row for each RUN * RUN lengths.
    runs = runs.withColumn("top", F.floor(F.col("run") / RUN))
    tops = runs.groupBy("top").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    above = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    tops = tops.select("top", zero(F.sum("d").over(above)).alias("d_top"), zero(F.sum("t").over(above)).alias("t_top"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    in_top = Window.partitionBy("top").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", "top", zero(F.sum("d").over(in_top)).alias("d_run"), zero(F.sum("t").over(in_top)).alias("t_run")).join(tops, "top")
    in_run = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.select("n_tokens", "n_docs", "run", F.sum("n_docs").over(in_run).alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(in_run).alias("t")).join(runs, "run")
    docs_ge, tokens_ge = F.col("d") + F.col("d_run") + F.col("d_top"), F.col("t") + F.col("t_run") + F.col("t_top")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("all_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - docs_ge + F.col("n_docs")) / F.col("all_docs")).alias("docs_le_share"),
        F.col("all_docs").alias("docs_total"),
        F.col("all_tokens").alias("tokens_total"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """One row for each limit: documents and tokens, of how many documents something is cut, and what stays.

    limit, docs, tokens, docs_cut, tokens_kept. The histogram is read once, all limits together.
    """
    n, d = F.col("n_tokens"), F.col("n_docs")
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    sums = [x for k, c in enumerate(limits) for x in (zero(F.least(n, F.lit(c)) * d, f"k{k}"), zero(F.when(n > c, d).otherwise(0), f"c{k}"))]
    total = hist.agg(zero(d, "docs"), zero(n * d, "tokens"), *sums)
    each = F.array(*[F.struct(F.lit(c).cast("long").alias("limit"), F.col(f"c{k}").alias("docs_cut"), F.col(f"k{k}").alias("tokens_kept")) for k, c in enumerate(limits)])
    return total.select("docs", "tokens", F.explode(each).alias("l")).select("l.limit", "docs", "tokens", "l.docs_cut", "l.tokens_kept")


def total_under(sums: DataFrame, limit: int) -> int:
    """Tokens of all documents when each is cut at limit; 0 for an empty table."""
    row = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    if row:
        longer = row["tokens_ge"], row["docs_ge"]
        return row["tokens_total"] - longer[0] + longer[1] * limit
    row = sums.first()
    return row["tokens_total"] if row else 0


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents doesn't exceed."""
    row = sums.where(F.col("docs_le_share") >= q).orderBy("n_tokens").first()
    return row["n_tokens"] if row else None


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(table(spark, sf_dir, "documents")))
