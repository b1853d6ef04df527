"""Vectors in cells around centroids: an index probed in rounds, and an exact join that leaves out far cells.

Centroids come from k-means over a bounded sample; every vector is dealt to the nearest. Angles between
unit vectors are a metric, so with a cell's radius, the widest angle to its centroid, the triangle
inequality says which vectors can come within an angle of any vector in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.search import QUERY_CELLS, best, ranked, unit_rows
from tidemill.storage import read_text, release, settle, write_text

#: Numbers of the sample that centroids are fitted on, rounds of k-means, and cells at most.
FIT_NUMBERS, ROUNDS, MOST_CELLS = 4_000_000, 8, 4096
#: Rows of a part of a cell, and rows that make a cell of a join worth its while.
PART_ROWS, JOIN_ROWS = 4096, 2048
#: Sampled rows whose neighbours say how many cells are probed at first, and the recall that this must reach.
ASKED, RECALL = 256, 0.99
#: What angles are off by at most, as numbers are rounded.
SLACK = 1e-6
#: Rows with an equal vector before them, and cells of all groups with their radii, that a broadcast may hold.
EQUAL_ROWS, MOST_RADII = 500_000, 1_000_000


def sampled(vectors: DataFrame, key: str, column: str) -> np.ndarray:
    """Unit vectors of the rows that come first by a hash of their key, FIT_NUMBERS numbers at most."""
    rows = vectors.where(F.col(column).isNotNull())
    one = rows.select(F.size(column)).first()
    if one is None:
        return np.zeros((0, 1))
    some = rows.select(F.xxhash64(key).alias("h"), F.col(column).alias("v")).orderBy("h").limit(max(1, FIT_NUMBERS // max(1, one[0])))
    return unit_rows(np.array([r.v for r in some.collect()], np.float64))


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by k-means on the sphere; a cell that loses all rows starts again at the row that fits worst."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)] if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if cells > 1 else 1):
        near, fit = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        centres = unit_rows(sums)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine, in blocks of bounded size."""
    at, fit = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    step = max(1, QUERY_CELLS // len(centres))
    for low in range(0, len(rows), step):
        s = rows[low : low + step] @ centres.T
        at[low : low + step], fit[low : low + step] = s.argmax(1), s.max(1)
    return at, fit


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = 10, recall: float = RECALL) -> int:
    """How many cells have so much of the k nearest of sampled rows, themselves left out."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    home, _ = nearest(sample, centres)
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # at which probe a cell's turn comes
    scores = asked @ sample.T
    k = min(k + 1, len(sample))
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    turns = np.take_along_axis(place, home[near], axis=1)
    return int(np.quantile(turns, recall, method="higher")) + 1


@dataclass(frozen=True)
class VectorIndex:
    """Where an index stands, its centroids, and how many cells a search probes at first."""

    path: str
    key: str
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def build(vectors: DataFrame, key: str, path: str, column: str = "embedding", cells: int | None = None, keep: tuple[str, ...] = ()) -> VectorIndex:
    """Writes vectors(key, column, keep...) by cell to path, all of them; null vectors stay out.

    There are about as many cells as the root of the number of rows, unless cells says otherwise. A
    cell of many rows lies in parts of about PART_ROWS.
    """
    sample = sampled(vectors, key, column)
    centres = fitted(sample, cells or min(MOST_CELLS, round(vectors.count() ** 0.5)))
    placed = settle(_placed(vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("v"), *keep), centres), "placed")
    placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).coalesce(1).write.parquet(f"{path}/cells")
    sizes = vectors.sparkSession.read.parquet(f"{path}/cells")
    rows = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts", "angle")
    rows.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")
    release(placed)
    spark, probes = vectors.sparkSession, probes_for(sample, centres) if len(sample) else 1
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    write_text(spark, f"{path}/index.json", json.dumps({"key": key, "probes": probes}))
    return VectorIndex(path, key, centres, probes)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index that stands at path, made by any session."""
    own = json.loads(read_text(spark, f"{path}/index.json"))
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    return VectorIndex(path, own["key"], np.array([r.centre for r in rows]), own["probes"])


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows(v, ...) with the nearest centroid and the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at, fit = nearest(unit_rows(np.stack(pdf["v"].to_numpy()).astype(np.float64)), shared.value)
                yield pdf.assign(cell=at.astype(np.int32), angle=np.arccos(np.clip(fit, -1, 1)))

    return rows.mapInPandas(run, f"{kept}, cell int, angle double")


def find(index: VectorIndex, queries: DataFrame, limit: int, where: Column | None = None, probes: int | None = None, exclude_self: bool = False) -> DataFrame:
    """The nearest vectors of queries(query_id, vector) in the cells nearest to them, by cosine, ties by key.

    where filters the indexed rows. Queries that have not found limit rows so far probe on, twice as
    many cells a round, until they have or all cells are through.
    """
    spark, key, centres = queries.sparkSession, index.key, index.centres
    shared = spark.sparkContext.broadcast(centres)
    ask_kind = queries.schema["query_id"].dataType.simpleString()

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q = unit_rows(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"query_id": pdf["query_id"], "vector": list(q), "cells": list(np.argsort(-(q @ shared.value.T), axis=1, kind="stable").astype(np.int32))})

    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    asked = settle(asked.mapInPandas(order, f"query_id {ask_kind}, vector array<double>, cells array<int>"), "asked")
    rows = index.rows(spark)
    parts = spark.read.parquet(f"{index.path}/cells").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.where(where) if where is not None else rows
    kind = rows.schema["key"].dataType.simpleString()

    def meet(keys: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        if len(q) and len(v):
            matrix, own = np.stack(q["vector"].to_numpy()), v["key"].to_numpy()
            near = unit_rows(np.stack(v["v"].to_numpy()).astype(np.float64)).T
            step = max(1, QUERY_CELLS // len(own))
            for low in range(0, len(matrix), step):
                for who, s in zip(q["query_id"].iloc[low : low + step], matrix[low : low + step] @ near, strict=True):
                    at = best(s, limit, own == who if exclude_self else None)
                    parts.append((np.full(len(at), who), own[at], s[at]))
        columns = map(np.concatenate, zip(*parts, strict=True)) if parts else ([], [], [])
        return pd.DataFrame(dict(zip(("query_id", "key", "score"), columns, strict=True)))

    found, left, at, size = None, asked, 0, probes or index.probes
    while at < len(centres):
        turn = left.select("query_id", "vector", F.explode(F.slice("cells", at + 1, size)).alias("cell")).join(F.broadcast(parts), "cell")
        met = turn.groupBy("cell", "part").cogroup(rows.select("cell", "part", "key", "v").groupBy("cell", "part")).applyInPandas(meet, f"query_id {ask_kind}, key {kind}, score double")
        met = ranked(met if found is None else found.unionByName(met), "key", limit).drop("rank")
        found = settle(met, "found")
        at, size = at + size, 2 * size
        full = found.groupBy("query_id").count().where(F.col("count") >= limit)
        left = left.join(full.select("query_id"), "query_id", "left_anti")
        if at >= len(centres) or left.isEmpty():
            break
    return ranked(found.withColumnRenamed("key", key), key, limit)


def equals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(k, v, g) whose vector is the first of its group by key, and (k, low) of the others with that key.

    Groups are found by 128 bits of hash; the vectors themselves are not shuffled.
    """
    hashed = rows.withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    groups = hashed.groupBy("g", "h").agg(F.min("k").alias("low"), F.count("*").alias("c")).where("c > 1").select("g", "h", "low")
    others = settle(hashed.select("g", "h", "k").join(groups, ["g", "h"]).where("k > low").select("k", "low", "g"), "equals")
    gone = others.select("k", "g")
    return rows.join(F.broadcast(gone) if others.count() <= EQUAL_ROWS else gone, ["k", "g"], "left_anti"), others


@dataclass
class Pairs:
    """pairs(low, high, similarity), and visits(g, cell, part, from_cell, from_part, n): which parts met, and by how many rows."""

    pairs: DataFrame
    visits: DataFrame
    parts: DataFrame

    def reach(self) -> DataFrame:
        """(compared, left_out): pairs of two parts of a group that met, and that never did."""
        due = self.parts.groupBy("g").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).scalar()
        return self.visits.agg(F.count("*").alias("compared")).select("compared", (due - F.col("compared")).alias("left_out"))


def similar(vectors: DataFrame, key: str, threshold: float, group: Column | None = None, column: str = "embedding", top: int | None = None, cells: int | None = None, part_rows: int = PART_ROWS) -> Pairs:
    """(low, high, similarity) of vectors of one group with a cosine of at least threshold, exact.

    A vector stays in its cell and visits those whose radius it can reach within the angle. Of two cells
    one visits the other, by turns. A task holds one part of a cell, and visitors pass it in batches.
    Equal vectors are one class, whose smallest key stands for all; its others are paired with it alone.
    With top, each task's threshold rises with the best pairs it has, and all that can be among the top
    best come out, no more than top and ties for each task.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(column).alias("v"), (group if group is not None else F.lit(0)).cast("long").alias("g")).where("v is not null")
    firsts, others = equals(rows)
    cells = cells or min(MOST_CELLS, max(1, firsts.count() // JOIN_ROWS))
    if cells > 1 and firsts.select("g").distinct().count() * cells > MOST_RADII:
        cells = 1  # so many groups are small ones
    centres = fitted(sampled(firsts, "k", "v"), cells) if cells > 1 else None
    placed = _placed(firsts, centres) if cells > 1 else firsts.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    placed = settle(placed, "placed")
    parts = settle(placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), F.max("angle").alias("radius")), "parts")
    known = F.broadcast(parts) if parts.count() <= MOST_RADII else parts
    placed = placed.join(known.drop("radius"), ["g", "cell"]).withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    reach, kind = float(np.arccos(np.clip(threshold, -1, 1))), vectors.schema[key].dataType.simpleString()
    radii = [tuple(r) for r in parts.select("g", "cell", "parts", "radius").collect()] if cells > 1 else []
    shared = vectors.sparkSession.sparkContext.broadcast((centres, radii))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for its own part, and for each part that it visits."""
        centres, radii = shared.value
        groups: dict[int, list[tuple[int, int, float]]] = {}
        for g, c, n, radius in radii:
            groups.setdefault(g, []).append((c, n, radius))
        for pdf in batches:
            if not len(pdf):
                continue
            yield pdf.assign(part=pdf["own"], guest=False, from_cell=pdf["cell"], from_part=pdf["own"])[names]
            angles = np.arccos(np.clip(unit_rows(np.stack(pdf["v"].to_numpy()).astype(np.float64)) @ centres.T, -1, 1)) if radii else np.zeros((len(pdf), 1))
            g_, c_, own = pdf["g"].to_numpy(), pdf["cell"].to_numpy(), pdf["own"].to_numpy()
            for g in np.unique(g_):
                for cell, n, radius in groups[g] if radii else [(0, int(pdf["parts"][g_ == g].iloc[0]), 0.0)]:
                    near = (g_ == g) & (angles[:, cell] <= reach + radius + SLACK)
                    for part in range(n):
                        before = (cell < c_) | ((cell == c_) & (part < own))
                        at = np.flatnonzero(near & ((c_ != cell) | (own != part)) & (before == ((c_ + own + cell + part) % 2 == 0)))
                        if len(at):
                            some = pdf.iloc[at]
                            yield some.assign(cell=np.int32(cell), part=np.int32(part), guest=True, from_cell=some["cell"], from_part=some["own"])[names]

    names = ["k", "v", "g", "cell", "part", "guest", "from_cell", "from_part"]
    columns = f"k {kind}, v {firsts.schema['v'].dataType.simpleString()}, g long, cell int, part int, guest boolean, from_cell int, from_part int"
    moved = placed.mapInPandas(visit, columns)
    dealt = moved.repartition("g", "cell", "part").sortWithinPartitions("g", "cell", "part", "guest")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, kept = threshold, np.zeros(0)
        at, home, names = None, np.zeros((0, 1)), np.zeros(0)

        def out(a: np.ndarray, ka: np.ndarray, b: np.ndarray, kb: np.ndarray, same: bool) -> pd.DataFrame:
            nonlocal least, kept
            s = a @ b.T
            i, j = np.nonzero(s >= least)
            if same:
                i, j = i[j > i], j[j > i]
            x, y, value = ka[i], kb[j], s[i, j]
            if top:
                kept = np.sort(np.concatenate([kept, value]))[-top:]
                if len(kept) == top:
                    least = max(threshold, kept[0] - SLACK)
            return pd.DataFrame({"low": np.minimum(x, y), "high": np.maximum(x, y), "similarity": value})

        for pdf in batches:
            for where, part in pdf.groupby(["g", "cell", "part"], sort=False):
                if where != at:
                    at, home, names = where, np.zeros((0, 1)), np.zeros(0)
                for guest, some in part.groupby("guest", sort=True):
                    m, k = unit_rows(np.stack(some["v"].to_numpy()).astype(np.float64)), some["k"].to_numpy()
                    if len(home):
                        yield out(home, names, m, k, False)
                    if not guest:
                        yield out(m, k, m, k, True)
                        home, names = (np.concatenate([home, m]), np.concatenate([names, k])) if len(home) else (m, k)

    pairs = dealt.mapInPandas(meet, f"low {kind}, high {kind}, similarity double")
    every = pairs.unionByName(others.select("low", F.col("k").alias("high"), F.lit(1.0).alias("similarity")))
    visits = moved.where("guest").groupBy("g", "cell", "part", "from_cell", "from_part").agg(F.count("*").alias("n"))
    sizes = moved.where("not guest").select("g", "cell", "part").distinct()
    return Pairs(every.where(F.col("similarity") >= threshold), visits, sizes)
