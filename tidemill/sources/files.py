"""Files of labels, pools, graded queries, histories, prompts and companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "timestamp string, suite string, config string, git_sha string, queries long, metric string, value double"
PROVIDERS = ("greenhouse", "lever", "ashby")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, lines that don't parse give no row."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(key, position, term) of a JSON object {key: [terms]}."""
    return _object(spark, path, "array<string>").select("key", F.posexplode("value").alias("position", "term"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(key, term, verdict) of {key: {keep, drop, added}}."""
    rows = _object(spark, path, "struct<keep:array<string>,drop:array<string>,added:array<string>>")
    parts = [rows.select("key", F.explode(f"value.{field}").alias("term"), F.lit(verdict).alias("verdict")) for field, verdict in (("keep", "kept"), ("drop", "dropped"), ("added", "added"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_pool(df: DataFrame, path: str) -> None:
    """df(key, position, term) as lines of {"key": ..., "terms": [...]}; as a whole object it would be one task's work."""
    rows = df.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("terms"))
    rows.write.mode("overwrite").json(path)


def _object(spark: SparkSession, path: str, value: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_graded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, judgements) of a YAML file of graded queries; a small file, read on the driver.

    queries(query_id, query, note, verified), judgements(query_id, source, source_id, grade).
    """
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    entries = (yaml.safe_load(text) or {}).get("queries") or []
    queries = [(str(e["id"]), e["query"], e.get("note") or "", bool(e.get("verified", False))) for e in entries]
    grades = [(str(e["id"]), *k.split(":", 1), int(g)) for e in entries for k, g in (e.get("judgements") or {}).items()]
    return spark.createDataFrame(queries, "query_id string, query string, note string, verified boolean"), spark.createDataFrame(grades, "query_id string, source string, source_id string, grade int")


def _whole(spark: SparkSession, path: str):
    """A small YAML or JSON file, read on the driver."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file of that content, in one part under the path."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_graded(spark: SparkSession, path: str, queries: DataFrame, judgements: DataFrame) -> None:
    """Graded queries as YAML, in order of id, with the judgements in order of key; a curated, small set."""
    import yaml

    grades: dict[str, dict[str, int]] = {}
    for r in judgements.orderBy("query_id", "source", "source_id").toLocalIterator():
        grades.setdefault(r.query_id, {})[f"{r.source}:{r.source_id}"] = r.grade
    rows = [{"id": r.query_id, "query": r.query, "note": r.note, "verified": r.verified, "judgements": grades.get(r.query_id, {})} for r in queries.orderBy("query_id").toLocalIterator()]
    write_text(spark, path, yaml.safe_dump({"version": 1, "queries": rows}, allow_unicode=True, sort_keys=False))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected_facts, must_refuse) of a YAML file of chat questions."""
    rows = [(str(c["id"]), c["question"], [str(f) for f in c.get("expected_facts") or []], bool(c.get("must_refuse", False))) for c in _whole(spark, path).get("questions") or []]
    return spark.createDataFrame(rows, "id string, question string, expected_facts array<string>, must_refuse boolean")


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, faithfulness, completeness) of a YAML file of answers that a person scored, and how many still wait for it."""
    every = _whole(spark, path).get("scored") or []
    rows = [(str(c["id"]), int(c["faithfulness"]), int(c["completeness"])) for c in every if c.get("faithfulness") is not None and c.get("completeness") is not None]
    return spark.createDataFrame(rows, "id string, faithfulness int, completeness int"), len(every) - len(rows)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term) accepted and (term) rejected: the lists of a YAML file whose names begin so, in small letters, each term once."""
    whole = _whole(spark, path)
    lists = [sorted({str(t).strip().lower() for k, terms in whole.items() if k.startswith(name) for t in terms or []}) for name in ("accepted", "rejected")]
    return tuple(spark.createDataFrame([(t,) for t in found], "term string") for found in lists)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """(name, provider, slug, city) of a YAML list of companies; a provider and slug stand there once, or it raises."""
    rows = [(c["name"], c["provider"], str(c["slug"]), c.get("city")) for c in _whole(spark, path)]
    keys = [r[1:3] for r in rows]
    if twice := sorted({k for k in keys if keys.count(k) > 1}):
        raise ValueError(f"companies that stand there twice: {twice}")
    return spark.createDataFrame(rows, "name string, provider string, slug string, city string")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(suite, config, metric, value) of a JSON file {suite: {config: {metric: value}}}; what is no number is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    suites = whole.select(F.explode("m").alias("suite", "v")).select("suite", F.explode(F.from_json("v", "map<string,string>")).alias("config", "c"))
    return suites.select("suite", "config", F.explode(F.from_json("c", "map<string,string>")).alias("metric", "t")).select("suite", "config", "metric", F.col("t").try_cast("double").alias("value")).where("value is not null")


def write_baseline(spark: SparkSession, path: str, baseline: DataFrame) -> None:
    """(suite, config, metric, value) as that JSON file, with sorted keys; a few rows a suite."""
    import json

    out: dict[str, dict[str, dict[str, float]]] = {}
    for r in baseline.toLocalIterator():
        out.setdefault(r.suite, {}).setdefault(r.config, {})[r.metric] = r.value
    write_text(spark, path, json.dumps(out, indent=2, sort_keys=True))


def verified_only(queries: DataFrame, judgements: DataFrame) -> DataFrame:
    """Verified queries with at least one grade above 0."""
    return queries.where("verified").join(judgements.where("grade > 0").select("query_id"), "query_id", "left_semi")


def append_history(run: DataFrame, path: str) -> None:
    """run(timestamp, suite, config, git_sha, queries, metrics MAP) as one CSV row a metric, rounded to 4."""
    long = run.select("timestamp", "suite", "config", "git_sha", "queries", F.explode("metrics").alias("metric", "value"))
    long.withColumn("value", F.round(F.col("value").cast("double"), 4)).write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str, suite: str | None = None, metric: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows in order of time; with limit, the last so many."""
    df = spark.read.schema(HISTORY).option("header", True).csv(path)
    for name, want in (("suite", suite), ("metric", metric)):
        df = df.where(F.col(name) == want) if want else df
    order = ["timestamp", "suite", "config", "metric"]
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order) if limit else df.orderBy(*order)


def replace_suite(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """(suite, metric, value): the suites of new take the place of their old ones."""
    return baseline.join(new.select("suite").distinct(), "suite", "left_anti").unionByName(new)


def version_order(stem: Column) -> Column:
    """Sorts v10 after v2: runs of digits compare as numbers, and before other runs."""
    runs = F.regexp_extract_all(stem, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: x.rlike(r"^\d+$")
    return F.transform(runs, lambda x: F.struct((~digits(x)).cast("int").alias("t"), F.coalesce(F.when(digits(x), x.cast("decimal(38,0)")), F.lit(0)).alias("n"), F.when(digits(x), "").otherwise(x).alias("s")))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, template) of files path/<name>/<version>.md."""
    files = spark.read.text(f"{path}/*/*.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return files.select(F.regexp_extract("p", r"([^/]+)/[^/]+\.md$", 1).alias("name"), F.regexp_extract("p", r"([^/]+)\.md$", 1).alias("version"), F.col("value").alias("template"))


def latest_prompts(prompts: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("version", "template"), version_order(F.col("version"))).alias("l")
    return prompts.groupBy("name").agg(last).select("name", "l.version", "l.template")


def read_seed(spark: SparkSession, path: str, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """(name, provider, slug, city, missing, duplicate) of a seed of one-line object literals.

    missing marks rows that lack a field, duplicate those whose board stands there twice.
    """
    def field(key: str) -> Column:
        raw = F.regexp_extract("value", rf'\b{key}:\s*"((?:[^"\\]|\\.)*)"', 1)
        return F.nullif(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit(""))

    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{\s*name:"))
    rows = lines.select(field("name").alias("name"), field("atsProvider").alias("provider"), field("atsSlug").alias("slug"), field("city").alias("city")).where(F.col("provider").isin(*providers))
    twice = rows.groupBy("provider", F.lower("slug").alias("_s")).agg((F.count("*") > 1).alias("duplicate"))
    bad = F.col("name").isNull() | F.col("slug").isNull() | F.col("city").isNull()
    return rows.withColumn("_s", F.lower("slug")).withColumn("missing", bad).join(twice, ["provider", "_s"], "left").select("name", "provider", "slug", "city", "missing", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def exposition(df: DataFrame, metric: str, labels: Sequence[str], value: str) -> DataFrame:
    """(line): one line of monitoring text a row, metric{label="value",...} value; for small results."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(escaped(c), F.lit("")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([show(v) for v in r]) for r in df.toLocalIterator())])
