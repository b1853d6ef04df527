"""Event-log operators as streams: windowed histograms, change capture, a sliding rate limit."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.storage import exists, names, remove

LIMIT, SECONDS = 10, 60


def counts(events: DataFrame, ts: str, by: list[str], value: str, bounds: tuple[float, ...], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Cumulative counts by window and labels; the same plan runs on a stream or a table."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    out = e.groupBy(F.window(ts, window).alias("w"), *by).agg(*sums, F.count("*").alias("total"))
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def changes(batch: DataFrame, latest: DataFrame, keys: list[str], hash_col: str, seq: str) -> DataFrame:
    """Rows of a batch that differ from the one before them of the same key, in order of seq.

    Before a key's first row stands what latest(keys, hash) has; a key that isn't there differs. Equal
    rows in a row are one change, and a return to an earlier version is a change.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    known = latest.select(*keys, F.col(hash_col).alias("_last"), F.lit(True).alias("_seen"))
    rows = batch.join(known, keys, "left").withColumn("_n", F.row_number().over(w)).withColumn("_before", F.when(F.col("_n") == 1, F.col("_last")).otherwise(F.lag(hash_col).over(w)))
    new = (F.col("_n") == 1) & F.col("_seen").isNull()
    return rows.where(new | ~F.col(hash_col).eqNullSafe(F.col("_before"))).select(*batch.columns)


def capture_changes(stream: DataFrame, path: str, keys: list[str], hash_col: str, seq: str, checkpoint: str, buckets: int = 64):
    """Appends to the table at path what differs from its latest row of the same key.

    Beside the table stands the latest hash of each key, in buckets by key: a batch reads and rewrites
    only the buckets that it touches. A manifest for each batch names the batch that last wrote each
    bucket. All is written under the number of the batch, so a batch that is run again reads the manifest
    before it and writes the same again; what only older manifests name is deleted.
    """
    state = f"{path.rstrip('/')}_latest"

    def manifest(spark: SparkSession, epoch: int | None) -> dict[int, int]:
        return {r.bucket: r.epoch for r in spark.read.parquet(f"{state}/manifest/{epoch}").collect()} if epoch is not None else {}

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = sorted(int(n) for n in names(spark, f"{state}/manifest") if n.isdigit() and int(n) < epoch and exists(spark, f"{state}/manifest/{n}/_SUCCESS"))
        before = manifest(spark, earlier[-1] if earlier else None)
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
        at = [f"{state}/data/epoch={before[b]}/_bucket={b}" for b in touched if b in before]
        kind = batch.select(*keys, hash_col)
        latest = spark.read.schema(kind.schema).parquet(*at) if at else kind.limit(0)
        changes(batch.drop("_bucket"), latest, keys, hash_col, seq).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        last = batch.groupBy(*keys).agg(F.max_by(hash_col, seq).alias(hash_col))
        now = latest.join(last, keys, "left_anti").unionByName(last).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        now.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{state}/data/epoch={epoch}")
        after = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(after.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/{epoch}")
        for n in earlier[:-1]:  # a batch that is run again needs the manifest before it, no earlier one
            for b, e in manifest(spark, n).items():
                if before.get(b) != e:
                    remove(spark, f"{state}/data/epoch={e}/_bucket={b}")
            remove(spark, f"{state}/manifest/{n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(times: Iterator[float], limit: int = LIMIT, seconds: float = SECONDS) -> list[bool]:
    """Accept while fewer than limit accepted calls are at most `seconds` old; rejected calls don't count."""
    recent: list[float] = []
    out = []
    for t in times:
        recent = [x for x in recent if t - x <= seconds]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def rate_limited(events: DataFrame, by: str, ts: str, order: str, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """(by, order, accepted). A caller's calls are folded in order; the state is at most limit times."""
    rows = events.select(by, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).repartition(by).sortWithinPartitions(by, "_t", order)
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, recent = object(), []
        for pdf in batches:
            out = []
            for who, t in zip(pdf[by], pdf["_t"] / 1e6, strict=True):
                if who != caller:
                    caller, recent = who, []
                recent = [x for x in recent if t - x <= seconds]
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pd.DataFrame({by: pdf[by], order: pdf[order], "accepted": out})

    return rows.mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, accepted boolean")


def cache_hits(events: DataFrame, by: str, ts: str, order: str, seconds: float = 300) -> DataFrame:
    """(by, order, hit): whether a key's answer was still cached; one that wasn't is stored anew for so many seconds."""
    return rate_limited(events, by, ts, order, 1, seconds).select(by, order, (~F.col("accepted")).alias("hit"))


def route(path: Column, templates: Sequence[str], none: str = "unmatched") -> Column:
    """The template that a path matches, {name} standing for one part of it; the first of several."""
    plain = F.regexp_replace(path, r"[?#].*$", "")
    pattern = lambda t: "^" + re.sub(r"\\\{[^}]*\\\}", "[^/]+", re.escape(t)) + "$"
    return F.coalesce(*[F.when(plain.rlike(pattern(t)), F.lit(t)) for t in templates], F.lit(none))
