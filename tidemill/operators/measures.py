"""Evaluation: retrieval metrics, agreement, set scores and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.storage import settle


def discount(position: Column) -> Column:
    """What a hit counts at a position from 1."""
    return 1 / F.log2(position + 1)


def harmonic(a: Column, b: Column) -> Column:
    """The harmonic mean; 0 where both are 0."""
    return F.when(a + b > 0, 2.0 * a * b / (a + b)).otherwise(0.0)


def ideal(grades: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, relevant, ideal_k...): gains of grades(query_id, key, grade) in their best order.

    All grades of a query meet in one task; where they are many, retrieval() takes counts instead.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "key")
    gain = F.col("grade") * discount(F.col("pos"))
    sums = [F.sum(F.when(F.col("pos") <= k, gain).otherwise(0.0)).alias(f"ideal_{k}") for k in ks]
    return grades.withColumn("pos", F.row_number().over(w)).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), *sums)


def retrieval(hits: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (5, 10), counts: DataFrame | None = None) -> DataFrame:
    """Per query: recall, precision, nDCG at each k, and the reciprocal rank.

    hits(query_id, key, rank); grades(query_id, key, grade), grade above 0 being relevant.
    Precision divides by the number returned, and nDCG's ideal uses all grades: those of grades,
    or of counts(query_id, grade, n) where given, and then grades need only hold the hits.
    """
    judged = hits.join(grades, ["query_id", "key"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = F.col("grade") * discount(F.col("rank"))
    per = judged.groupBy("query_id").agg(
        *[x for k in ks for x in (
            F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias(f"rel{k}"),
            F.count_if(F.col("rank") <= k).alias(f"ret{k}"),
            F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg{k}"),
        )],
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    if counts is None:
        j = per.join(ideal(grades, ks), "query_id")
    else:
        w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = counts.where("grade > 0 AND n > 0").groupBy("query_id", "grade").agg(F.sum("n").alias("n")).withColumn("end", F.sum("n").over(w))
        # A position's discount, summed over those of a grade within the first k.
        due = lambda k: F.col("grade") * sum(F.when((F.col("end") - F.col("n") < p) & (F.col("end") >= p), 1 / math.log2(p + 1)).otherwise(0.0) for p in range(1, k + 1))
        best = ends.groupBy("query_id").agg(F.sum("n").alias("relevant"), *[F.sum(due(k)).alias(f"ideal_{k}") for k in ks])
        j = per.join(best, "query_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    cols = [c for k in ks for c in (share(f"rel{k}", "relevant").alias(f"recall_{k}"), share(f"rel{k}", f"ret{k}").alias(f"precision_{k}"), share(f"dcg{k}", f"ideal_{k}").alias(f"ndcg_{k}"))]
    return j.select("query_id", *cols, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def means(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    own = [c for c in metrics.columns if c not in (*by, "query_id")]
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in own])


def kappa(df: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """Cohen's kappa of two raters; linear weights if weighted. Nulls are ungraded and left out.

    Full expected agreement gives 1, no rows give 0.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count("*").alias("n"))
    weight = F.abs(F.col("a") - F.col("b")) if weighted else (F.col("a") != F.col("b")).cast("double")
    seen = cells.agg(F.sum(weight * F.col("n")).alias("o"), F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    # How often each rater gives each category. What chance would give follows from these alone: by
    # category for plain weights, and for linear ones by how many lie on either side of each gap.
    side = lambda c, na, nb: cells.select(F.col(c).alias("v"), na.alias("na"), nb.alias("nb"))
    gives = side("a", F.col("n"), F.lit(0)).unionByName(side("b", F.lit(0), F.col("n"))).groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    if weighted:
        up = Window.orderBy("v")
        below = gives.select(F.sum("na").over(up).alias("ca"), F.sum("nb").over(up).alias("cb"), (F.lead("v").over(up) - F.col("v")).alias("gap"))
        total = cells.agg(F.sum("n")).scalar()
        due = below.agg(F.sum(F.col("gap") * (F.col("ca") * (total - F.col("cb")) + F.col("cb") * (total - F.col("ca")))))
    else:
        due = gives.agg((F.sum("na") * F.sum("nb") - F.sum(F.col("na") * F.col("nb"))).cast("double"))
    e = F.coalesce(due.scalar(), F.lit(0.0))
    k = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(e == 0, 1.0).otherwise(1 - F.col("o") * F.col("n") / e)
    return seen.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("same") / F.col("n"), F.lit(0.0)).alias("agreement"), k.alias("kappa"))


def set_scores(df: DataFrame, gold: str, found: str) -> DataFrame:
    """Pooled precision, recall and F1, mean F1, exact and empty shares of label sets."""
    tp, ng, nf = F.size(F.array_intersect(gold, found)), F.size(gold), F.size(found)
    own = F.when((ng == 0) & (nf == 0), 1.0).otherwise(2.0 * tp / (ng + nf))
    s = df.select(tp.alias("tp"), ng.alias("g"), nf.alias("f"), own.alias("own"), (F.array_sort(gold) == F.array_sort(found)).alias("same")).agg(
        F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("f").alias("f"), F.avg("own").alias("macro_f1"),
        F.avg(F.col("same").cast("double")).alias("exact"), F.avg((F.col("f") == 0).cast("double")).alias("empty_share"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.select(share("tp", "f").alias("precision"), share("tp", "g").alias("recall"), F.when(F.col("f") + F.col("g") > 0, 2.0 * F.col("tp") / (F.col("f") + F.col("g"))).otherwise(1.0).alias("micro_f1"), "macro_f1", "exact", "empty_share", (F.col("empty_share") >= 0.9).alias("collapsed"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], grade: str = "grade") -> DataFrame:
    """(keys, a, b): what both raters graded, side by side; a key that one of them left out, or graded null, goes."""
    own = lambda df, name: df.where(F.col(grade).isNotNull()).select(*keys, F.col(grade).alias(name))
    return own(a, "a").join(own(b, "b"), keys)


def micro_f1(df: DataFrame, gold: str, found: str) -> DataFrame:
    """(micro_f1) of pooled label sets; 0 if either side has no label at all."""
    s = df.agg(F.sum(F.size(F.array_intersect(gold, found))).alias("tp"), F.sum(F.size(gold)).alias("g"), F.sum(F.size(found)).alias("f"))
    return s.select(F.when((F.coalesce("g", F.lit(0)) > 0) & (F.coalesce("f", F.lit(0)) > 0), 2.0 * F.col("tp") / (F.col("g") + F.col("f"))).otherwise(0.0).alias("micro_f1"))


def confusion(df: DataFrame, a: str, b: str, grades: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(a, b, n): how often one rater gave a grade where the other gave one, every pair of grades once."""
    grid = df.sparkSession.createDataFrame([(x, y) for x in grades for y in grades], "a int, b int")
    cells = df.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(cells, ["a", "b"], "left").fillna(0, ["n"])


def evaluate(configs: dict[str, DataFrame], grades: DataFrame, latencies: DataFrame | None = None, ks: tuple[int, ...] = (5, 10), counts: DataFrame | None = None) -> DataFrame:
    """(config, queries, metrics...): the mean metrics of each configuration's hits, and its p50 and p95 latency.

    latencies(config, latency_ms) is one row a query.
    """
    out = None
    for name, hits in configs.items():
        own = retrieval(hits, grades, ks, counts).withColumn("config", F.lit(name))
        out = own if out is None else out.unionByName(own)
    metrics = means(out, ["config"]).join(out.groupBy("config").agg(F.count("*").alias("queries")), "config")
    if latencies is not None:
        metrics = metrics.join(nearest_rank(latencies, ["config"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "config", "left")
    return metrics


def gate(metrics: DataFrame, floors: DataFrame, baseline: DataFrame, drop: float = 0.05) -> DataFrame:
    """metrics(metric, value) against floors(metric, floor) and baseline(metric, was)."""
    j = metrics.join(floors, "metric", "left").join(baseline, "metric", "left")
    below, fell = F.coalesce(F.col("value") < F.col("floor"), F.lit(False)), F.coalesce(F.col("was") - F.col("value") > drop, F.lit(False))
    return j.select("metric", "value", below.alias("below_floor"), fell.alias("regressed"), (~below & ~fell).alias("passed"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions; 1 where it is undefined."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    of = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n"))).scalar()
    pa, pb = of(a), of(b)
    s = cells.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("n")).withColumn("due", pa * pb / pairs("n")).withColumn("top", (pa + pb) / 2)
    return s.select(F.when(F.col("top") == F.col("due"), 1.0).otherwise((F.col("both") - F.col("due")) / (F.col("top") - F.col("due"))).alias("ari"))


#: Values that a rank is sought among by sorting them; of more, the leading digits are counted first.
SORTED, BUCKETS = 4096, 1024


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: dict[str, float], at_once: int = SORTED) -> DataFrame:
    """Nearest-rank percentiles: the value at position ceil(q n) of a group's sorted values, exact in bounded memory.

    Values are counted by sign and exponent; the bucket that holds the rank is then cut into BUCKETS
    parts of its range, as often as it takes until at_once values are left, which are sorted. So a pass
    keeps a few thousand counts a group, however many values that has. Nulls don't count, NaN is the
    greatest, and a group of nulls alone has null percentiles.
    """
    kind = df.schema[value].dataType
    rows = df.select(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_v"))
    totals = settle(rows.groupBy("_g").agg(F.count("_v").alias("_n")), "totals")
    asked = F.array(*[F.struct(F.lit(name).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n"))).cast("long").alias("rank")) for name, q in qs.items()])
    sought = totals.where("_n > 0").select("_g", F.col("_n").alias("_c"), F.explode(asked).alias("_a")).select("_g", "_c", "_a.q", "_a.rank")
    sought = sought.select("*", F.lit(float("-inf")).alias("_lo"), F.lit(float("nan")).alias("_hi"))
    first = True
    while True:
        sought = settle(sought, "sought")
        wide = sought.where((F.col("_c") > at_once) & (F.col("_lo") != F.col("_hi")))
        if wide.isEmpty():
            break
        code = _exponent(F.col("_v")) if first else F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS).cast("int")
        counted = _between(rows, wide).groupBy("_g", "q", "rank", code.alias("_code")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        up_to = F.sum("_c").over(Window.partitionBy("_g", "q").orderBy("_code"))
        hit = counted.withColumn("_t", up_to).where((F.col("_t") >= F.col("rank")) & (F.col("_t") - F.col("_c") < F.col("rank")))
        narrowed = hit.select("_g", "_c", "q", (F.col("rank") - F.col("_t") + F.col("_c")).alias("rank"), "_lo", "_hi")
        sought, first = narrowed.unionByName(sought.where((F.col("_c") <= at_once) | (F.col("_lo") == F.col("_hi")))), False
    place = F.row_number().over(Window.partitionBy("_g", "q").orderBy("_v"))
    few = _between(rows, sought.where(F.col("_lo") != F.col("_hi"))).withColumn("_n", place).where(F.col("_n") == F.col("rank")).select("_g", "q", "_v")
    found = few.unionByName(sought.where(F.col("_lo") == F.col("_hi")).select("_g", "q", F.col("_lo").alias("_v")))
    wide = found.groupBy("_g").agg(*[F.max(F.when(F.col("q") == name, F.col("_v"))).cast(kind).alias(name) for name in qs])
    return totals.select("_g").join(wide, "_g", "left").select("_g.*", *qs)


def _exponent(v: Column) -> Column:
    """A number that grows with v and is equal for values of one sign and exponent; NaN comes last."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    of = F.when(F.abs(v) == float("inf"), 4000).when(v == 0, 0).otherwise(size)
    return F.when(F.isnan(v), 5000).when(v < 0, -of).otherwise(of)


def _between(rows: DataFrame, sought: DataFrame) -> DataFrame:
    """Each value of rows(_g, _v) with the percentiles of its group that lie between the same bounds."""
    near = F.broadcast(sought) if sought.count() <= SORTED else sought
    return rows.where(F.col("_v").isNotNull()).join(near.drop("_c"), "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def verdict(condition: Column) -> Column:
    return F.when(condition, "pass").otherwise("fail")


def best_config(metrics: DataFrame, metric: str) -> DataFrame:
    """The config of the highest value; metrics(config, position, values...), the first of equals wins."""
    return metrics.orderBy(F.desc(metric), "position").limit(1)


def winner(configs: DataFrame, base: str, metric: str, gain: float = 0.05, p95: float = 500.0) -> DataFrame:
    """configs(config, p95_ms, metric) that gain enough over the base fast enough, the best one first.

    Adds `passing` and `chosen`; of equal metrics the lower p95 is chosen.
    """
    was = configs.where(F.col("config") == base).agg(F.max(metric)).scalar()
    j = configs.withColumn("passing", F.coalesce((F.col("config") != base) & (F.col(metric) - was >= gain) & (F.col("p95_ms") < p95), F.lit(False)))
    first = j.where("passing").agg(F.min_by("config", F.struct(-F.col(metric), "p95_ms", "config"))).scalar()
    return j.withColumn("chosen", F.coalesce(F.col("config") == first, F.lit(False)))


def compare(metrics: DataFrame, left: str, right: str) -> DataFrame:
    """metrics(version, metric, value) of two versions side by side, and right less left."""
    wide = metrics.where(F.col("version").isin(left, right)).groupBy("metric").agg(F.max(F.when(F.col("version") == left, F.col("value"))).alias("left"), F.max(F.when(F.col("version") == right, F.col("value"))).alias("right"))
    return wide.withColumn("delta", F.col("right") - F.col("left"))


def chat_scores(df: DataFrame) -> DataFrame:
    """Scores of answers(faithfulness 0..2, completeness 0..2, cited, must_refuse, refused, cost_usd).

    refusal_accuracy is 1 where nothing had to be refused; no rows give nulls and 1.
    """
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(
        (F.avg("faithfulness") / 2).alias("faithfulness"), (F.avg("completeness") / 2).alias("completeness"), share(F.col("cited")).alias("citation_rate"),
        F.coalesce(share(F.when(F.col("must_refuse"), F.col("refused"))), F.lit(1.0)).alias("refusal_accuracy"), F.sum("cost_usd").alias("cost_usd"),
    )


def calibration(df: DataFrame, pairs: dict[str, tuple[str, str]], key: str, at_least: int = 20, floor: float = 0.4) -> DataFrame:
    """Agreement and kappa of a human and a machine by dimension; trustworthy with enough rows and kappa on key."""
    out = None
    for name, (a, b) in pairs.items():
        k = kappa(df, a, b).select(F.lit(name).alias("dimension"), "n", "agreement", "kappa")
        out = k if out is None else out.unionByName(k)
    own = out.agg(F.max(F.when(F.col("dimension") == key, (F.col("n") >= at_least) & (F.col("kappa") >= floor)))).scalar()
    return out.withColumn("trustworthy", own)


def hit_share(hits: DataFrame, good: Column, k: int = 10, by: list[str] = ()) -> DataFrame:
    """Mean over queries of the share of their first k hits that are good."""
    per = hits.where(F.col("rank") <= k).groupBy(*by, "query_id").agg(F.avg(good.cast("double")).alias("_s"))
    return per.groupBy(*by).agg(F.avg("_s").alias("share"), F.count("*").alias("queries"))


def bucket_quantile(histogram: DataFrame, by: list[str], q: float) -> DataFrame:
    """A quantile by linear interpolation in cumulative buckets (by, le, n).

    In the infinite bucket it is the highest finite bound; null without rows.
    """
    w = Window.partitionBy(*by).orderBy("le")
    b = histogram.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_rank", q * F.max("n").over(Window.partitionBy(*by)))
    hit = b.where((F.col("n") >= F.col("_rank")) & (F.col("_rank") > 0))
    value = F.when(F.isnan("le") | (F.col("le") == float("inf")), F.col("_low")).when(F.col("n") == F.col("_below"), F.col("le")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_below")) / (F.col("n") - F.col("_below")))
    return hit.groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def firing(evaluations: DataFrame, by: list[str], ts: str, broken: Column, seconds: int) -> DataFrame:
    """Adds `firing`: the condition has held without a break for that long up to the evaluation."""
    w = Window.partitionBy(*by).orderBy(ts)
    e = evaluations.withColumn("_b", F.coalesce(broken, F.lit(False)))
    e = e.withColumn("_run", F.sum((~F.col("_b")).cast("int")).over(w))
    since = F.min(F.when(F.col("_b"), F.unix_timestamp(ts))).over(Window.partitionBy(*by, "_run"))
    return e.withColumn("firing", F.col("_b") & (F.unix_timestamp(ts) - since >= seconds)).drop("_b", "_run")
