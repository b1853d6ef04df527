"""Skills, demand, weekly shares, spend, latency histograms and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


def skill_counts(df: DataFrame, skills: str) -> DataFrame:
    """Rows of each skill and their share of all rows, rows without skills included."""
    total = df.agg(F.count("*")).scalar()
    return df.select(F.explode(skills).alias("skill")).groupBy("skill").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def coverage(df: DataFrame, skills: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.size(skills) > 0).cast("double")), F.lit(0.0)).alias("coverage"))


def demand(df: DataFrame, cities: str, remote: str, none: str = "City not stated") -> DataFrame:
    """Rows and remote share by city; a row in several cities counts in each."""
    city = F.explode(F.when(F.size(cities) > 0, F.col(cities)).otherwise(F.array(F.lit(none)))).alias("city")
    return df.select(city, remote).groupBy("city").agg(F.count("*").alias("postings"), F.avg(F.col(remote).cast("double")).alias("remote_share"))


def week_end(ts: Column) -> Column:
    """The Sunday that ends the week."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)


def weekly_share(df: DataFrame, ts: str, flags: dict[str, Column]) -> DataFrame:
    """Share of rows with each flag by week; empty weeks have no row."""
    return df.where(F.col(ts).isNotNull()).groupBy(week_end(F.col(ts)).alias("week")).agg(*[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])


def recent(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows without a date or of the last days."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")))


def spend(calls: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls, tokens, cost, latency, attempts and failures by day, feature and backend, of calls after `since`.

    Calls of which one token count is unknown add none to the tokens.
    """
    rows = calls if since is None else calls.where(F.col("created_at") > since)
    return rows.groupBy(F.to_date("created_at").alias("day"), "feature", "backend").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.round(F.avg("latency_ms")).alias("avg_ms"),
        F.round(F.avg("attempts"), 2).alias("avg_attempts"),
        F.count_if(~F.col("ok")).alias("failures"),
    )


def overspent(calls: DataFrame, limit: float) -> DataFrame:
    """(day, spent, over): what each day cost, and whether that is more than the limit."""
    return calls.groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.sum("cost_usd"), 4).alias("spent")).withColumn("over", F.col("spent") > limit)


def remote_share(df: DataFrame, remote: str) -> DataFrame:
    """(remote_share): 0 for no rows."""
    return df.agg(F.coalesce(F.avg(F.col(remote).cast("double")), F.lit(0.0)).alias("remote_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of each value that isn't null, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def summary(df: DataFrame, ts: str, now: Column, source: str, remote: str, skills: str, cities: str, days: int = 90, top_skills: int = 15, top_cities: int = 10) -> DataFrame:
    """One row: window_days, postings, sources (a map), remote_share, and the top skills and cities of recent rows.

    Sources, skills and cities are few; each list is cut before it is gathered into the row.
    """
    rows = recent(df, ts, now, days)

    def line(of: DataFrame, n: int, key: str, **names: str) -> Column:
        """The first n rows as an array of structs, in order."""
        rows = of.limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.col(key)).alias("o"), *names.values()))).alias("l"))
        return rows.select(F.transform("l", lambda x: F.struct(*[x[c].alias(k) for k, c in names.items()]))).scalar()

    of_skills = skill_counts(rows, skills).orderBy(F.desc("n"), "skill")
    of_cities = demand(rows, cities, remote).orderBy(F.desc("postings"), "city")
    sources = value_counts(rows, source).agg(F.map_from_entries(F.collect_list(F.struct("value", "n")))).scalar()
    out = rows.agg(F.count("*").alias("postings"), F.round(F.coalesce(F.avg(F.col(remote).cast("double")), F.lit(0.0)), 3).alias("remote_share"))
    top = {"top_skills": line(of_skills, top_skills, "n", skill="skill", postings="n", share="share"), "top_regions": line(of_cities, top_cities, "postings", city="city", postings="postings", remote_share="remote_share")}
    return out.withColumns({"window_days": F.lit(days), "sources": sources} | top)


def histogram(df: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts: rows of at most each bound, and all rows under le = inf."""
    sums = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*sums, F.count("*").alias("_all"))
    les = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return wide.select(*by, F.explode(les).alias("_b")).select(*by, "_b.le", "_b.n")


def stale(df: DataFrame, by: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """Keys whose last row is older than the limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max(F.col(ts)))
    return df.groupBy(by).agg(age.cast("long").alias("age_seconds")).withColumn("stale", F.col("age_seconds") > seconds)
