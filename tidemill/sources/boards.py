"""Board payloads as JSON text into one table of postings, as column expressions.

Two steps, kept apart: `items` cuts what a board sent into raw items, one a job, all of them; a
source's `parse` reads raw items and says of each whether it is a posting. A payload that doesn't
parse is an item that is no posting, never an error of the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import chunks, money, text
from tidemill.storage import settle

# The fields that are read of each source's job.
GREENHOUSE = "id STRING,title STRING,location STRUCT<name STRING>,content STRING,first_published STRING,updated_at STRING,absolute_url STRING"
LEVER = "id STRING,text STRING,categories STRUCT<location STRING,allLocations ARRAY<STRING>>,description STRING,lists ARRAY<STRUCT<text STRING,content STRING>>,additional STRING,createdAt STRING,workplaceType STRING,hostedUrl STRING,applyUrl STRING"
ASHBY = "id STRING,title STRING,location STRING,secondaryLocations ARRAY<STRUCT<location STRING>>,publishedAt STRING,isListed BOOLEAN,isRemote BOOLEAN,address STRUCT<postalAddress STRUCT<addressCountry STRING>>,jobUrl STRING,applyUrl STRING,descriptionHtml STRING,descriptionPlain STRING"
REMOTEOK = "id STRING,company STRING,position STRING,description STRING,location STRING,salary_min LONG,salary_max LONG,date STRING,url STRING"
COMMENT = "id STRING,author STRING,created_at STRING,text STRING"
COMPANY_CHARS, TITLE_CHARS = 80, 120
# What in a part of a comment's header says that it is pay, in any case, or a place.
PAY_HINT = r"[\$£€₹]|\b\d{2,3}\s*[kK]\b|\b\d{5,6}\b|salary|comp\b"
PLACE_HINT = r",|remote|onsite|on-site|hybrid|\b[A-Z]{2}\b"

#: Columns of a posting, in order.
POSTING = ("source", "source_id", "title", "company", "location", "remote_hint", "salary_raw", "html", "url", "posted_at")


def _filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _either(*parts: Column) -> Column:
    """The first part that isn't empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def _joined(places: Column) -> Column:
    """Non-empty places in order, trimmed and joined by "; "; null if none."""
    return F.nullif(F.array_join(F.filter(F.transform(F.array_compact(places), lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit(""))


def _date(c: Column) -> Column:
    return F.try_to_timestamp(c)


@dataclass(frozen=True)
class Source:
    """A source: where its jobs stand in what it sends, what is read of one, and when it is a posting."""

    name: str
    jobs: str | None
    schema: str
    columns: Callable[..., dict[str, Column]]
    by_company: bool = True
    #: What Arrow-batched functions make of a job, as columns beside it; null if nothing.
    before: Callable[[Column], Column] | None = None

    def items(self, raw: DataFrame) -> DataFrame:
        """(source, source_id, slug, payload) of raw(slug, payload): every job with an id, as it came."""
        each = F.from_json("payload", f"{self.jobs} ARRAY<STRING>")[self.jobs] if self.jobs else F.from_json("payload", "ARRAY<STRING>")
        job_id = F.get_json_object("payload", "$.id")
        own = F.concat_ws(":", "slug", job_id) if self.by_company else job_id
        jobs = raw.select("slug", F.explode(each).alias("payload"))
        return jobs.where(job_id.isNotNull() & (job_id != "")).select(F.lit(self.name).alias("source"), own.alias("source_id"), "slug", "payload")

    def parse(self, items: DataFrame, companies: DataFrame | None = None) -> DataFrame:
        """Columns POSTING of each item, and `usable`: whether it is a posting at all.

        companies(provider, slug, name) names the company of a board's jobs, whatever the payload
        says; a board that isn't there has no company. Title and company are trimmed, and neither
        may be empty. An item whose payload doesn't parse is not usable.
        """
        rows = items.select("source", "source_id", "slug", F.from_json("payload", self.schema).alias("j"))
        if self.by_company:
            own = companies.where(F.col("provider") == self.name).select("slug", F.col("name").alias("_company"))
            rows = rows.join(own, "slug", "left")
        else:
            rows = rows.withColumn("_company", F.lit(None).cast("string"))
        if self.before:
            rows = rows.withColumn("_before", self.before(F.col("j")))
            found = self.columns(F.col("j"), F.col("_before"))
        else:
            found = self.columns(F.col("j"))
        gate = found.pop("gate", F.lit(True))
        c = {"company": F.col("_company"), "remote_hint": F.lit(False), "salary_raw": F.lit(None).cast("string")} | found
        c |= {"title": F.trim(c["title"]), "company": F.trim(c["company"])}
        rows = rows.select("source", "source_id", *[v.alias(k) for k, v in c.items()], gate.alias("_gate"))
        usable = F.coalesce(F.col("_gate"), F.lit(False)) & _filled(F.col("title")) & _filled(F.col("company"))
        return rows.select(*POSTING, usable.alias("usable"))


def _wanted(title: Column, *places: Column) -> Column:
    """In India by one of the places, and of a target role."""
    return text.is_target_role(title) & F.array_max(F.array(*[text.is_india(p) for p in places]))


def _greenhouse(j: Column) -> dict[str, Column]:
    place = F.nullif(F.trim(j["location"]["name"]), F.lit(""))
    return {
        "title": j["title"], "location": place, "html": unescaped(F.coalesce(j["content"], F.lit(""))), "url": F.coalesce(j["absolute_url"], F.lit("")),
        "posted_at": _date(_either(j["first_published"], j["updated_at"])), "gate": _wanted(j["title"], place),
    }


def _lever(j: Column) -> dict[str, Column]:
    place = F.coalesce(_joined(j["categories"]["allLocations"]), F.nullif(F.trim(j["categories"]["location"]), F.lit("")))
    some = lambda c: F.coalesce(c, F.lit(""))
    lists = F.transform(F.coalesce(j["lists"], F.array()), lambda x: F.concat(F.lit("<h3>"), some(x["text"]), F.lit("</h3>"), some(x["content"])))
    parts = F.filter(F.concat(F.array(some(j["description"])), lists, F.array(some(j["additional"]))), lambda x: x != "")
    return {
        "title": j["text"], "location": place, "html": F.array_join(parts, "\n"), "url": F.coalesce(_either(j["hostedUrl"], j["applyUrl"]), F.lit("")),
        "posted_at": F.timestamp_millis(j["createdAt"].try_cast("double").cast("long")), "remote_hint": F.coalesce(j["workplaceType"] == "remote", F.lit(False)), "gate": _wanted(j["text"], place),
    }


def _ashby(j: Column) -> dict[str, Column]:
    more = F.transform(F.coalesce(j["secondaryLocations"], F.array()), lambda x: x["location"])
    place, country = _joined(F.concat(F.array(j["location"]), more)), j["address"]["postalAddress"]["addressCountry"]
    return {
        "title": j["title"], "location": place, "html": _either(j["descriptionHtml"], j["descriptionPlain"]), "url": F.coalesce(_either(j["jobUrl"], j["applyUrl"]), F.lit("")),
        "posted_at": _date(j["publishedAt"]), "remote_hint": F.coalesce(j["isRemote"], F.lit(False)), "gate": F.coalesce(j["isListed"], F.lit(True)) & _wanted(j["title"], place, country),
    }


def _remoteok(j: Column) -> dict[str, Column]:
    low, high = F.nullif(j["salary_min"], F.lit(0)), F.nullif(j["salary_max"], F.lit(0))
    figure = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    pay = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(figure(low), F.lit(" - "), figure(high))).otherwise(figure(F.coalesce(low, high)))
    return {
        "title": j["position"], "company": j["company"], "location": j["location"], "html": j["description"], "url": F.coalesce(_either(j["url"]), F.concat(F.lit("https://remoteok.com/remote-jobs/"), j["id"])),
        "posted_at": _date(j["date"]), "salary_raw": F.concat(pay, F.lit(" per year")), "remote_hint": F.lit(True),
    }


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_parts(pages):
    """Parts between the pipes of the first line of a comment's text."""
    lines = pages.map(lambda x: chunks.plain_text(x).split("\n", 1)[0])
    return lines.map(lambda x: [p.strip() for p in x.split("|") if p.strip()])


def _comment(j: Column, parts: Column) -> dict[str, Column]:
    company, title, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    pay = F.get(F.filter(rest, lambda x: x.rlike(f"(?iU){PAY_HINT}")), F.lit(0))
    places = F.filter(rest, lambda x: x.rlike(f"(?U){PLACE_HINT}") & ~F.coalesce(x == pay, F.lit(False)))
    return {
        "title": title, "company": company, "location": F.get(places, F.lit(0)), "salary_raw": pay, "html": j["text"], "url": F.concat(F.lit("https://news.ycombinator.com/item?id="), j["id"]),
        "posted_at": _date(j["created_at"]), "remote_hint": text.is_remote(F.array_join(parts, " ")),
        "gate": (F.size(parts) >= 2) & (F.length(company) <= COMPANY_CHARS) & (F.length(title) <= TITLE_CHARS),
    }


@F.pandas_udf(T.StringType())
def unescaped(pages):
    """Character references decoded, which is once more than the parser does."""
    import html

    return pages.map(lambda x: None if x is None else html.unescape(x))


SOURCES: dict[str, Source] = {
    "greenhouse": Source("greenhouse", "jobs", GREENHOUSE, _greenhouse),
    "lever": Source("lever", None, LEVER, _lever),
    "ashby": Source("ashby", "jobs", ASHBY, _ashby),
    "remoteok": Source("remoteok", None, REMOTEOK, _remoteok, by_company=False),
    "hackernews": Source("hackernews", "children", COMMENT, _comment, by_company=False, before=lambda j: header_parts(j["text"])),
}
DEFAULTS = ("greenhouse", "lever", "ashby")


def get(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def parsed(items: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings of raw items of any sources, each read by its own; sources that are unknown raise."""
    out = None
    for name in sorted(r.source for r in items.select("source").distinct().collect()):
        part = get(name).parse(items.where(F.col("source") == name), companies)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else get(DEFAULTS[0]).parse(items, companies)


def skipped(parsed: DataFrame) -> DataFrame:
    """(source, fetched, skipped): items of each source, and those that are no postings."""
    return parsed.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(~F.col("usable")).alias("skipped"))


def silver(parsed: DataFrame) -> DataFrame:
    """Usable postings with every field cleaned: the row that is stored."""
    p = parsed.where("usable").withColumn("description", chunks.strip_html("html"))
    p = money.with_pay(p, "salary_raw", "pay")
    yearly = lambda c: money.annualised(F.col(f"pay.{c}"), F.col("pay.period"))
    place = text.normalise_location(F.col("location"))
    return p.select(
        "source", "source_id", "title", "company", place.alias("location"), (F.col("remote_hint") | text.is_remote(F.col("location"), F.col("title"))).alias("is_remote"),
        "salary_raw", F.col("pay.min").alias("salary_min"), F.col("pay.max").alias("salary_max"), F.col("pay.period").alias("salary_period"), F.col("pay.currency").alias("salary_currency"),
        yearly("min").alias("salary_min_year"), yearly("max").alias("salary_max_year"), "description", "url", "posted_at", text.content_hash(F.col("title"), F.col("company"), place).alias("content_hash"),
    )


def until_enough(boards: DataFrame, limit: int, order: str = "position", usable: str = "usable") -> DataFrame:
    """Boards in order up to the one that brings the usable jobs to the limit; one row a board.

    Boards are dealt into ranges of their order, and the ranges' sums added up. Ranges that end before
    the limit stay whole, the one that reaches it is ordered, and later ones are not looked at again.
    """
    ranges = settle(boards.repartitionByRange(order).withColumn("_r", F.spark_partition_id()), "ranges")
    before, whole, last = 0, [], None
    for r in ranges.groupBy("_r").agg(F.sum(F.coalesce(usable, F.lit(0))).alias("s")).orderBy("_r").collect():  # as many as there are partitions
        if before >= limit:
            break
        if before + r.s >= limit:
            last = (r._r, before)
        else:
            whole.append(r._r)
        before += r.s
    out = ranges.where(F.col("_r").isin(whole)).drop("_r")
    if last is None:
        return out
    sums = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rest = ranges.where(F.col("_r") == last[0]).withColumn("_s", F.coalesce(F.sum(usable).over(sums), F.lit(0)))
    return out.unionByName(rest.where(F.col("_s") < limit - last[1]).drop("_r", "_s"))


def audit(parsed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Jobs, jobs in India and jobs kept by board, the id before its first colon.

    failed(board, status) adds boards that sent nothing, with their status; the others are ok, or
    empty where no job came.
    """
    board = F.substring_index("source_id", ":", 1).alias("board")
    out = parsed.groupBy(board).agg(F.count("*").alias("jobs_total"), F.count_if(text.is_india(F.col("location"))).alias("jobs_in_india"), F.count_if("usable").alias("jobs_kept"))
    if failed is None:
        return out.withColumn("status", F.lit("ok"))
    j = out.join(failed.select("board", F.col("status").alias("_f")), "board", "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs_total", "jobs_in_india", "jobs_kept")]
    return j.select("board", *zero, F.coalesce("_f", F.lit("ok")).alias("status"))
