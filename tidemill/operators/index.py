"""A stored inverted index in blocks, and exact top-k search that skips the blocks which cannot matter.

Documents are dealt into slices by their key, and within a slice into cells of about CELL documents of
like mass, the sum of their weights. A block holds what one term has in one cell: the documents' keys
with their weights, and the highest of these. Blocks of a slice lie in its own folder, sorted by term, so
the terms asked for prune row groups and a slice is rebuilt without the others.

A document of a cell scores at most the sum of the highest weights that the asked terms have in it.
These bounds are read without any document. The cells of the highest bounds are scored first; the k-th
best score so far is a threshold, and no block of a cell whose bound is below it is read. As cells hold
documents of like mass, the many short documents mostly stay below.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import search
from tidemill.storage import read_text, release, remove, settle, write_text

#: Documents of a cell, of a slice and of a file of a slice, about, and the most slices.
CELL, SLICE, FILE, SLICES = 64, 65_536, 8192, 4096
#: Cells are scored first until they have so many times the limit of documents with a term.
FIRST = 2
#: Kinds of mass for each doubling of it.
STEPS = 4
#: Sums of weights differ in their last digits by the order of adding up.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """Where an index stands and how it was made."""

    path: str
    key: str
    fields: tuple[tuple[str, float], ...]
    slices: int
    analyse: Callable[[Column], Column] = search.terms

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")

    def slice_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slices)).cast("int")


def build(docs: DataFrame, key: str, fields: dict[str, float], path: str, analyse: Callable[[Column], Column] = search.terms, slices: int | None = None) -> Index:
    """Writes the index of docs(key, fields) to path, where nothing may stand yet.

    Rows of one key are one document; null fields have no terms.
    """
    index = Index(path.rstrip("/"), key, tuple(fields.items()), slices or max(1, min(SLICES, -(-docs.count() // SLICE))), analyse)
    _store(index, _blocks(index, docs), "errorifexists")
    write_text(docs.sparkSession, f"{index.path}/index.json", json.dumps({"key": key, "fields": fields, "slices": index.slices}))
    return index


def opened(spark: SparkSession, path: str, analyse: Callable[[Column], Column] = search.terms) -> Index:
    """The index that stands at path, made by any session; analyse must be what it was built with."""
    own = json.loads(read_text(spark, f"{path.rstrip('/')}/index.json"))
    return Index(path.rstrip("/"), own["key"], tuple(own["fields"].items()), own["slices"], analyse)


def replace(index: Index, docs: DataFrame, slices: list[int]) -> None:
    """Writes the named slices anew from docs, which holds at least their documents; the others stay as they are."""
    spark = docs.sparkSession
    own = docs.where(index.slice_of(F.col(index.key)).isin(slices))
    made = settle(_blocks(index, own), "slices")
    for n in slices:
        remove(spark, f"{index.path}/blocks/slice={n}")
    _store(index, made, "append")
    release(made)


def _store(index: Index, blocks: DataFrame, mode: str) -> None:
    blocks.sortWithinPartitions("slice", "term", "cell").write.mode(mode).partitionBy("slice").parquet(f"{index.path}/blocks")


def _blocks(index: Index, docs: DataFrame) -> DataFrame:
    """(slice, term, cell, top, size, entries): the blocks of docs. Texts are analysed once; weights alone are shuffled."""
    cut = docs.select(F.col(index.key).alias("key"), *[index.analyse(F.col(f)).alias(f"_f{i}") for i, (f, _) in enumerate(index.fields)])

    def counted(i: int, weight: float) -> Column:
        return F.transform(search.counted(F.col(f"_f{i}")), lambda x: F.struct(x["term"].alias("term"), (x["n"] * F.lit(float(weight))).alias("weight"), x["n"].cast("int").alias("n")))

    rows = settle(cut.select("key", F.concat(*[counted(i, w) for i, (_, w) in enumerate(index.fields)]).alias("terms")), "terms")
    mass = F.aggregate(F.transform("terms", lambda x: x["weight"]), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("*", index.slice_of(F.col("key")).alias("slice"), F.floor(STEPS * F.log2(1 + mass)).cast("int").alias("level"))
    # A level of a slice is cut into cells by hash; how many is a small table, at most some hundred levels a slice.
    sizes = rows.groupBy("slice", "level").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    part = F.pmod(F.xxhash64(F.lit(7), "key"), F.col("cells")).cast("long")
    placed = rows.join(F.broadcast(sizes), ["slice", "level"]).select("slice", (F.col("level").cast("long") * (1 << 32) + part).alias("cell"), "key", F.explode("terms").alias("t"))
    if len(index.fields) > 1:
        placed = placed.groupBy("slice", "cell", "key", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight"), F.sum("t.n").cast("int").alias("n"))
    else:
        placed = placed.select("slice", "cell", "key", "t.term", "t.weight", "t.n")
    files = _files(sizes, index.slices)
    blocks = placed.groupBy("slice", "term", "cell").agg(F.max("weight").alias("top"), F.count("*").cast("int").alias("size"), F.collect_list(F.struct("key", "weight", "n")).alias("entries"))
    # Numbered, not hashed: hashes would put the blocks of several files into one task.
    return blocks.repartitionById(index.slices * files, (F.col("slice") * files + F.pmod(F.xxhash64("term"), F.lit(files))).cast("int"))


def _files(sizes: DataFrame, slices: int) -> int:
    """Files of a slice: one for each FILE documents of the largest, and so many that all cores have some."""
    largest = sizes.groupBy("slice").agg(F.sum("cells").alias("c")).agg(F.max("c")).first()[0] or 1
    return max(1, -(-int(largest) * CELL // FILE), -(-sizes.sparkSession.sparkContext.defaultParallelism // slices))


@dataclass
class Found:
    """hits(query_id, key, score, rank), and reads(query_id, blocks, read): a query's blocks, and those that were read."""

    hits: DataFrame
    reads: DataFrame


def find(index: Index, queries: DataFrame, limit: int, scale: float = 1.0) -> Found:
    """The limit best documents of OR queries(query_id, text), exact: any term matches, ties by key.

    scale multiplies the scores; a limit of 0 ranks all that match. A query without terms, or whose
    terms no document has, has no hits.
    """
    spark, key, cell = queries.sparkSession, index.key, ["query_id", "slice", "cell"]
    asked = settle(queries.select("query_id", F.explode(F.array_distinct(index.analyse(F.col("text")))).alias("term")), "asked")
    blocks = index.blocks(spark)
    heads = blocks.select("slice", "cell", "term", "top", "size").join(asked, "term")
    # The block of most documents says how many a cell has at least.
    bounds = settle(heads.groupBy(*cell).agg(F.sum("top").alias("bound"), F.max("size").alias("docs"), F.count("*").alias("blocks")), "bounds")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice", "cell")
    few = bounds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, FIRST * limit))
    begin = few.withColumn("_d", F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("_d", F.lit(0)) < max(1, FIRST * limit)).drop("_n", "_d")
    scored = settle(_scored(blocks, asked, begin), "scored")
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("_n") <= limit)
    reached = best.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).alias("threshold"))
    rest = bounds.join(begin.select(*cell), cell, "left_anti").join(reached, "query_id", "left")
    rest = settle(rest.where(F.col("threshold").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("threshold"))).drop("threshold"), "rest")
    every = scored.unionByName(_scored(blocks, asked, rest)).withColumn("score", F.col("score") * scale)
    read = begin.unionByName(rest).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    reads = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id").select("query_id", "blocks", "read")
    return Found(search.ranked(every.withColumnRenamed("key", key), key, limit), reads)


def _scored(blocks: DataFrame, asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, key, score) of the documents of cells(query_id, slice, cell); a document lies in one cell."""
    hit = blocks.join(asked, "term").join(cells.select("query_id", "slice", "cell"), ["query_id", "slice", "cell"])
    rows = hit.select("query_id", F.explode("entries").alias("e"))
    return rows.groupBy("query_id", F.col("e.key").alias("key")).agg(F.sum("e.weight").alias("score"))


def postings(index: Index, spark: SparkSession) -> DataFrame:
    """(key, term, weight, n): all that the index holds."""
    rows = index.blocks(spark).select("term", F.explode("entries").alias("e"))
    return rows.select(F.col("e.key").alias(index.key), "term", F.col("e.weight").alias("weight"), F.col("e.n").alias("n"))


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, key): all documents that have any term of a query, each once."""
    asked = queries.select("query_id", F.explode(F.array_distinct(index.analyse(F.col("text")))).alias("term"))
    rows = index.blocks(queries.sparkSession).select("term", F.transform("entries", lambda e: e["key"]).alias("keys")).join(asked, "term")
    return rows.select("query_id", F.explode("keys").alias(index.key)).distinct()
