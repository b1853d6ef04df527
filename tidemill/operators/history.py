"""Append-only history and current state: change detection, latest rows, upsert, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is last by order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changed(incoming: DataFrame, history: DataFrame, keys: list[str], hash_col: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose hash differs from the latest stored one; an unseen key or null hash differs.

    Only keys and hashes are joined with: the latest hash is an aggregate with map-side combine.
    """
    last = history.groupBy(*keys).agg(F.max_by(hash_col, F.struct(*order)).alias("_last"))
    return incoming.join(last, keys, "left").where(~F.col(hash_col).eqNullSafe(F.col("_last")) | F.col("_last").isNull()).drop("_last")


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """current with updates merged in by key; columns in keep hold their first value.

    The extra column `action` says inserted, updated or untouched.
    """
    c, u = current.withColumn("_c", F.lit(True)), updates.withColumn("_u", F.lit(True))
    j = c.alias("c").join(u.alias("u"), keys, "full")
    values = [x for x in current.columns if x not in keys]
    pick = [(F.coalesce(f"c.{x}", f"u.{x}") if x in keep else F.when(F.col("_u"), F.col(f"u.{x}")).otherwise(F.col(f"c.{x}"))).alias(x) for x in values]
    action = F.when(F.col("_c").isNull(), "inserted").when(F.col("_u"), "updated").otherwise("untouched")
    return j.select(*keys, *pick, action.alias("action"))


def prune(current: DataFrame, alive: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(alive.select(*keys).distinct(), keys, "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Work still to do: rows of left whose key isn't in right."""
    return left.join(right.select(*keys), keys, "left_anti")


def duplicate_excess(df: DataFrame, hash_col: str) -> DataFrame:
    groups = df.groupBy(hash_col).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("excess"))


def hash_groups(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(id, class_id, links) of rows whose hash another row has: the smallest id of them, and how many others there are.

    The members of a group are never paired with each other; a null hash groups with nothing.
    """
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col), F.col(hash_col).alias("_h"))
    groups = rows.groupBy("_h").agg(F.min(id_col).alias("class_id"), (F.count("*") - 1).alias("links")).where("links > 0")
    return rows.join(groups, "_h").select(id_col, "class_id", "links")


def pair_count(df: DataFrame, *keys: Column) -> DataFrame:
    """(pairs): how many pairs of rows agree in all keys, counted by group; rows with a null key pair with nothing."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).dropna(subset=names)
    return rows.groupBy(*names).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).alias("pairs"))


def relation(df: DataFrame, keep: list[str], arrays: list[str], position: str = "position") -> DataFrame:
    """Arrays of one row side by side as rows, with their position from 1; the shorter ones end in nulls."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_z")
    return df.select(*keep, zipped).select(*keep, (F.col("_i") + 1).alias(position), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def with_ids(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Rows whose key is in a list of ids, which is broadcast if it is no longer than `most`."""
    own = ids.select(key).distinct()
    return df.join(F.broadcast(own) if own.limit(most + 1).count() <= most else own, key, "left_semi")
