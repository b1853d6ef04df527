"""Logs of runs and calls, the life of a run, and the write path from raw items to current postings."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import history
from tidemill.sources import boards
from tidemill.storage import exists

log = logging.getLogger(__name__)

RUN = "run_id string, source string, status string, at timestamp, fetched long, inserted long, updated long, duplicates long, error string"
CALL = "feature string, backend string, model string, prompt_name string, prompt_version string, prompt string, response string, prompt_tokens long, completion_tokens long, cost_usd double, latency_ms long, ok boolean, attempts int, error string, created_at timestamp"


def start(spark: SparkSession, path: str, run_id: str, source: str) -> None:
    """Notes that a run has begun."""
    _append(spark, path, RUN, [(run_id, source, "running", None, None, None, None, None)])


def finish(spark: SparkSession, path: str, run_id: str, source: str, status: str = "ok", fetched: int = 0, inserted: int = 0, updated: int = 0, duplicates: int = 0, error: str | None = None) -> None:
    """Notes how a run has ended."""
    _append(spark, path, RUN, [(run_id, source, status, fetched, inserted, updated, duplicates, error)])


def _append(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    names = [p.split()[0] for p in schema.split(", ")]
    plain = ", ".join(p for p in schema.split(", ") if not p.startswith("at "))
    df = spark.createDataFrame(rows, plain).withColumn("at", F.current_timestamp())
    df.select(*names).write.mode("append").parquet(path)


def current(events: DataFrame) -> DataFrame:
    """Runs by their last event: (run_id, source, status, started_at, finished_at, counts, error).

    Events are appended, never changed; an end outweighs a start of the same instant.
    """
    ended = F.col("status") != "running"
    last = F.max_by(F.struct("status", "fetched", "inserted", "updated", "duplicates", "error"), F.struct("at", ended.cast("int")))
    per = events.groupBy("run_id", "source").agg(last.alias("l"), F.min("at").alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"))
    return per.select("run_id", "source", "l.status", "started_at", "finished_at", "l.fetched", "l.inserted", "l.updated", "l.duplicates", "l.error")


def last_finished(runs: DataFrame, by: str = "source", at: str = "started_at") -> DataFrame:
    """The last run of each source that isn't running any more."""
    return history.latest(runs.where("status <> 'running'"), [by], [F.col(at), F.col("run_id")])


def last_ok(runs: DataFrame) -> DataFrame:
    """When each source last ended well."""
    return runs.where("status = 'ok'").groupBy("source").agg(F.max("finished_at").alias("finished_at"))


def today(calls: DataFrame, now: Column, at: str = "created_at") -> DataFrame:
    """Calls since the day began, and what they cost."""
    return calls.where(F.col(at) >= F.date_trunc("day", now)).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd"))


def log_calls(calls: DataFrame, path: str) -> bool:
    """Appends calls to their log. A log that can't be written never breaks what it describes."""
    try:
        names = [p.split()[0] for p in CALL.split(", ")]
        have = set(calls.columns)
        calls.select(*[F.col(n) if n in have else F.lit(None).alias(n) for n in names]).select(*[F.col(p.split()[0]).cast(p.split()[1]) for p in CALL.split(", ")]).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        log.exception("could not log the calls")
        return False


def store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or an empty one where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


BRONZE = "source string, source_id string, slug string, payload string, payload_hash string, run_id string, fetched_at timestamp, seq long"


def to_bronze(items: DataFrame, stored: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Raw items that differ from the latest stored of their key, as rows to append.

    Of equal items in one batch one is kept, so a batch sent twice stores once.
    """
    own = items.withColumn("payload_hash", text.payload_hash(F.col("payload"))).dropDuplicates(["source", "source_id", "payload_hash"])
    new = history.changed(own, stored.select("source", "source_id", "payload_hash", "fetched_at", "seq"), ["source", "source_id"], "payload_hash", [F.col("fetched_at"), F.col("seq")])
    return new.select("source", "source_id", "slug", "payload", "payload_hash", F.lit(run_id).alias("run_id"), at.alias("fetched_at"), F.monotonically_increasing_id().alias("seq"))


def bronze_scan(bronze: DataFrame, run_id: str | None = None, source: str | None = None) -> DataFrame:
    """Items of one run, or the latest of each key over all runs; of one source if asked."""
    rows = bronze.where(F.col("source") == source) if source else bronze
    if run_id:
        return rows.where(F.col("run_id") == run_id)
    return history.latest(rows, ["source", "source_id"], [F.col("fetched_at"), F.col("seq")])


#: Columns of a scan of current postings, in order.
SILVER = ("id", "source", "source_id", "title", "company", "location", "is_remote", "salary_raw", "salary_min_year", "salary_max_year", "salary_currency", "description", "url", "posted_at", "content_hash", "first_seen_at")


def silver_scan(postings: DataFrame, source: str | None = None) -> DataFrame:
    """The fixed columns of postings, of one source if asked; a missing remote flag is false."""
    rows = postings.where(F.col("source") == source) if source else postings
    return rows.select(*[F.coalesce(c, F.lit(False)).alias(c) if c == "is_remote" else c for c in SILVER])


def transform(bronze: DataFrame, silver: DataFrame, companies: DataFrame, now: Column, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """What postings become when all of bronze is parsed again, and what that does.

    Returns (postings with `action`, counts): inserted, updated, untouched or pruned. Nothing is
    written, so a dry run is a call whose first result isn't used. With prune, a posting goes whose
    latest item is no posting any more; one without any item stays.
    """
    parsed = boards.parsed(bronze_scan(bronze), companies)
    new = boards.silver(parsed).withColumns({"first_seen_at": now, "last_seen_at": now})
    merged = history.upsert(silver, new, ["source", "source_id"], keep=["first_seen_at"])
    if prune:
        doomed = rejected(silver, parsed).select("source", "source_id", F.lit(True).alias("_doomed"))
        merged = merged.join(doomed, ["source", "source_id"], "left")
        merged = merged.withColumn("action", F.when(F.col("_doomed"), "pruned").otherwise(F.col("action"))).drop("_doomed")
    return merged.where("action <> 'pruned'"), merged.groupBy("action").agg(F.count("*").alias("postings"))


def rejected(silver: DataFrame, parsed: DataFrame) -> DataFrame:
    """Current postings whose item was parsed and is no posting, by source and id."""
    keys = ["source", "source_id"]
    no = parsed.where("not usable").select(*keys).join(parsed.where("usable").select(*keys), keys, "left_anti")
    return silver.join(no.distinct(), keys, "left_semi").orderBy(*keys)


def lifecycle(spark: SparkSession, path: str, run_id: str, source: str, work: Callable[[], dict[str, int]]) -> str:
    """Runs the work between a start and an end in the run log; a failure is noted, never raised.

    work returns counts for the log. What it wrote before it failed must be its own to undo: writes
    here are whole files that appear when they are complete.
    """
    start(spark, path, run_id, source)
    try:
        counts = work()
    except Exception as e:  # noqa: BLE001  one source's failure must not stop the others
        log.exception("run %s of %s failed", run_id, source)
        finish(spark, path, run_id, source, "failed", error=str(e)[:1000])
        return "failed"
    finish(spark, path, run_id, source, "ok", **counts)
    return "ok"


def cascade(gone: DataFrame, postings: DataFrame, chunks: DataFrame, pairs: DataFrame, key: str = "posting_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, chunks and duplicate pairs (posting_id, duplicate_of) without the gone keys, at both ends of a pair."""
    own = gone.select(key).distinct()
    ends = pairs.join(own, key, "left_anti").join(own.withColumnRenamed(key, "duplicate_of"), "duplicate_of", "left_anti")
    return postings.join(own, key, "left_anti"), chunks.join(own, key, "left_anti"), ends.select(*pairs.columns)


def record_pairs(stored: DataFrame, pairs: DataFrame, method: str) -> DataFrame:
    """Stored verdicts (posting_id, duplicate_of, method, similarity) with new pairs merged in; again changes nothing."""
    new = pairs.select("posting_id", "duplicate_of", F.lit(method).alias("method"), "similarity").groupBy("posting_id", "duplicate_of", "method").agg(F.max("similarity").alias("similarity"))
    return stored.join(new, ["posting_id", "duplicate_of", "method"], "left_anti").unionByName(new)
