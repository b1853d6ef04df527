"""Label sets: review, adjudication, gold building, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disagreement(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def disputes(df: DataFrame, teacher: str, rules: str) -> DataFrame:
    """Rows whose sets differ: what both have, what one has alone."""
    t, r = F.col(teacher), F.col(rules)
    return df.select("*", F.array_sort(F.array_intersect(t, r)).alias("agreed"), F.array_sort(F.array_except(t, r)).alias("teacher_only"), F.array_sort(F.array_except(r, t)).alias("rules_only")).where("size(teacher_only) + size(rules_only) > 0")


def adjudicated(teacher: Column, rules: Column, taxonomy: Column, accepted: Column, text: Column) -> Column:
    """What both have, what the rules have alone, and accepted new terms that stand in the text."""
    new = F.filter(F.array_except(teacher, rules), lambda x: ~F.array_contains(taxonomy, x) & F.array_contains(accepted, x) & F.contains(F.lower(text), x))
    return F.array_sort(F.array_distinct(F.concat(F.array_intersect(teacher, rules), F.array_except(rules, teacher), new)))


def gold(df: DataFrame, offered: str, kept: str, dropped: str, added: str) -> DataFrame:
    """Sorted labels, and whether kept and dropped split what was offered."""
    o, k, d = F.col(offered), F.col(kept), F.col(dropped)
    ok = (F.size(F.array_except(o, F.array_union(k, d))) == 0) & (F.size(F.array_except(F.array_union(k, d), o)) == 0)
    return df.withColumn("label", F.array_sort(F.array_union(k, F.col(added)))).withColumn("valid", ok)


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def split(df: DataFrame, key: str, test_size: int, seed: int) -> DataFrame:
    """Adds `part`: the first test_size rows in hash order are test."""
    chosen = df.select(F.col(key).alias("_k"), hash_order(seed, F.col(key)).alias("_h")).orderBy("_h", "_k").limit(test_size).select("_k", F.lit(True).alias("_t"))
    return df.join(F.broadcast(chosen) if test_size <= 1_000_000 else chosen, F.col(key) == F.col("_k"), "left").withColumn("part", F.when(F.col("_t"), "test").otherwise("train")).drop("_k", "_t")


def balance(df: DataFrame, key: str, empty: Column, share: float, seed: int) -> DataFrame:
    """All rows that aren't empty, and so many empty ones that they make at most the share."""
    filled = df.where(~empty)
    keep = int(filled.count() * share / (1 - share))
    return filled.unionByName(df.where(empty).orderBy(hash_order(seed, F.col(key)), key).limit(keep))


def decided(df: DataFrame, decisions: DataFrame, key: str, teacher: str, rules: str) -> DataFrame:
    """df with `label`: the decision's terms tidied and sorted, or what both labellers have where there is none.

    decisions(key, terms); a decision of no terms counts as one.
    """
    d = decisions.select(key, F.array_sort(F.array_distinct(F.filter(F.transform("terms", lambda x: F.trim(F.lower(x))), lambda x: x != ""))).alias("_t"))
    return df.join(d, key, "left").withColumn("label", F.coalesce("_t", F.array_sort(F.array_intersect(teacher, rules)))).drop("_t")


def pool(df: DataFrame, key: str, teacher: str, rules: str, seed: int) -> DataFrame:
    """(key, term, origin, position): each term that either labeller gives, in hash order within its key."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    rows = df.select(F.col(key), low(rules).alias("_r"), low(teacher).alias("_t")).withColumn("term", F.explode(F.array_union("_r", "_t")))
    by_rules, by_teacher = F.array_contains("_r", F.col("term")), F.array_contains("_t", F.col("term"))
    origin = F.when(by_rules & by_teacher, "both").when(by_rules, "rules").otherwise("teacher")
    w = Window.partitionBy(key).orderBy(hash_order(seed, F.concat(F.col(key).cast("string"), F.lit("|"), F.col("term"))), "term")
    return rows.select(key, "term", origin.alias("origin"), F.row_number().over(w).alias("position"))


def provenance(verdicts: DataFrame, origins: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Counts by origin and verdict of verdicts(key, term, verdict) against origins(key, term, origin).

    A term nobody offered is human_only where it is kept or added, and the teacher's where it is dropped.
    """
    unknown = F.when(F.col("verdict") == "dropped", "teacher").otherwise("human_only")
    j = verdicts.join(origins.select(key, "term", "origin"), [key, "term"], "left")
    return j.groupBy(*by, F.coalesce("origin", unknown).alias("origin"), "verdict").agg(F.count("*").alias("n"))


def pass_pairs(first: DataFrame, second: DataFrame, key: str, offered: DataFrame) -> DataFrame:
    """(key, term, a, b): whether each pass kept each offered term, 0 or 1; first and second are (key, term)."""
    mark = lambda df, name: df.select(key, "term").distinct().withColumn(name, F.lit(1))
    j = offered.select(key, "term").join(mark(first, "a"), [key, "term"], "left").join(mark(second, "b"), [key, "term"], "left")
    return j.fillna(0, ["a", "b"])


def merge_grades(stored: DataFrame, new: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """(keys, grade) with new grades over stored ones, zeros kept.

    With replace, the stored grades of queries that get any new one go; keys start with the query.
    """
    fresh = new.select(*keys, F.col("grade").alias("_g"))
    if replace:
        touched = new.select(keys[0]).distinct()
        stored = stored.join(touched, keys[0], "left_anti")
    j = stored.select(*keys, "grade").join(fresh, keys, "full")
    return j.select(*keys, F.coalesce("_g", "grade").alias("grade"))


def to_label(candidates: DataFrame, done: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Candidates without a label yet, by natural key, in its order; limit is the size of a batch."""
    rest = candidates.join(done.select(*keys), keys, "left_anti").orderBy(*keys)
    return rest.limit(limit) if limit else rest


#: Keys of a split that a fingerprint may be made of.
FINGERPRINT_ROWS = 100_000


def fingerprint(df: DataFrame, key: str, length: int = 12) -> DataFrame:
    """The first hex digits of sha256 of the keys in order, joined by bars.

    The keys meet in one row, so this is for held-out splits and refuses more than FINGERPRINT_ROWS;
    digest() is for whole corpora.
    """
    if df.select(key).limit(FINGERPRINT_ROWS + 1).count() > FINGERPRINT_ROWS:
        raise ValueError(f"a fingerprint is of at most {FINGERPRINT_ROWS} keys; use digest")
    return df.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "|"), 256), 1, length).alias("fingerprint"), F.count("*").alias("rows"))


def digest(df: DataFrame, key: str) -> DataFrame:
    """An order-free digest that combines map-side: rows, and the sum of 60-bit md5 prefixes."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def hold_out(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A split whose test part is that share of the rows, one at least."""
    return split(df, key, max(1, int(df.count() * share)), seed)


#: Fixed value: labelled rows that a training needs.
TRAINING_ROWS = 50


def training_part(df: DataFrame, part: str = "part") -> DataFrame:
    """The train rows of a split; fewer than TRAINING_ROWS raise."""
    from tidemill.operators import topics

    rows = df.where(F.col(part) == "train")
    topics.require_rows(rows, TRAINING_ROWS, "training")
    return rows


def chat_rows(df: DataFrame, prompt: str, title: Column, description: Column, label: str) -> DataFrame:
    """One JSON column: a system, a user and an assistant turn that answers with the sorted label."""
    from tidemill.functions import text

    answer = F.to_json(F.struct(F.array_sort(label).alias("skills")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(F.to_json(F.struct(F.array(turn("system", F.lit(prompt)), turn("user", text.render(title, description)), turn("assistant", answer)).alias("messages"))).alias("value"))


def overlay(df: DataFrame, given: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """df with the label that given(keys, label) has for its key, in place of its own; rows without one go."""
    return df.drop(label).join(given.select(*keys, label), keys)


def without(df: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't held out."""
    return df.join(held_out.select(*keys), keys, "left_anti")


def review_summary(df: DataFrame, teacher: str, rules: str, verified: Column) -> DataFrame:
    """(examples, verified, agreed, disputed, teacher_only_mentions, rules_only_mentions)."""
    t, r = F.size(F.array_except(teacher, rules)), F.size(F.array_except(rules, teacher))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.agg(F.count("*").alias("examples"), F.count_if(verified).alias("verified"), F.count_if(t + r == 0).alias("agreed"), F.count_if(t + r > 0).alias("disputed"), zero(t).alias("teacher_only_mentions"), zero(r).alias("rules_only_mentions"))


def adjudication_summary(df: DataFrame, teacher: str, label: str, rules: str, taxonomy: Column) -> DataFrame:
    """What adjudication did: examples, mean_labels, accepted terms beyond the taxonomy, and the teacher's terms it refused.

    A refused term of the taxonomy was invented, for the rules would have found it; another one is not in the text.
    """
    known = lambda x: F.array_contains(taxonomy, F.lower(x))
    refused = F.array_except(F.array_except(teacher, rules), label)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.agg(
        F.count("*").alias("examples"), F.coalesce(F.bround(F.avg(F.size(label)), 2), F.lit(0.0)).alias("mean_labels"), zero(F.size(F.filter(label, lambda x: ~known(x)))).alias("accepted_off_taxonomy"),
        zero(F.size(F.filter(refused, known))).alias("rejected_invented"), zero(F.size(F.filter(refused, lambda x: ~known(x)))).alias("rejected_not_in_text"),
    )


def second_pass(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """size rows for a second look, the same ones each time: those first in hash order."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(size)
