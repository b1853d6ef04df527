"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.storage import release, scratch, settle, shared_dir, spread  # noqa: F401

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256
#: Bytes of an Arrow batch on its way to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _reads_files(plan) -> bool:
    """Whether a plan only selects from one table of Parquet files, the same way each time."""
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "Repartition"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"  # others don't number their rows


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a key of each row, the same on every read.

    Rows of Parquet files are known by 128 bits of their file's name and their place in it. Any other
    table is settled first with a number for each row.
    """
    name = fresh(docs, "row_key")
    if _reads_files(docs._jdf.queryExecution().analyzed()) and "_metadata" not in docs.columns:
        at = F.col("_metadata.file_path")
        key = F.struct(F.xxhash64(at).alias("f"), F.xxhash64(F.reverse(at)).alias("g"), F.col("_metadata.row_index").alias("i"))
        return docs.select("*", key.alias(name)), name
    number = F.monotonically_increasing_id()
    key = F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g"), number.alias("i"))
    return settle(docs.select("*", key.alias(name)), "keyed"), name


#: Groups that a broadcast may hold, and the largest groups of a larger table that are broadcast apart.
BROADCAST_ROWS, HOT_GROUPS = 50_000, 50_000
#: Keys of dropped rows that a broadcast may hold.
DROP_ROWS = 500_000


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str) -> DataFrame:
    """rows with the row of groups(on, size, ...) that has their key; null keys and others stay, with nulls.

    groups has one row for each key, and size says how many rows have it; both tables are read
    twice, so they should be settled. Groups are broadcast up to BROADCAST_ROWS. Beyond, the
    HOT_GROUPS largest are, so a key left to the shuffle has at most one HOT_GROUPS-th of all rows.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on, "left")
    hot = settle(groups.orderBy(F.desc(size), on).limit(HOT_GROUPS), "hot")
    names = F.broadcast(hot.select(on))
    cold = rows.where(F.col(on).isNotNull()).join(names, on, "left_anti")
    none = rows.where(F.col(on).isNull()).join(F.broadcast(hot.limit(0)), on, "left")
    return rows.join(F.broadcast(hot), on).unionByName(cold.join(groups.join(names, on, "left_anti"), on, "left")).unionByName(none)


def drop_rows(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose key is in dropped(key); the key column goes.

    Keys are broadcast up to DROP_ROWS; beyond, both sides are shuffled by their keys, which are
    unique, so no key is hot.
    """
    gone = settle(dropped.select(F.col(dropped.columns[0]).alias(key)), "dropped")
    gone = F.broadcast(gone) if gone.count() <= DROP_ROWS else gone
    return docs.join(gone, key, "left_anti").drop(key)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    """True for ids that may be learned from; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs fn over tuples of the named columns, partition by partition, in bounded slices.

    Other columns of df are not read, so their names cannot clash.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    out = spark.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        kept: list[tuple] = []
        for row in fn(rows()):
            kept.append(row)
            if len(kept) >= SLICE:
                yield _batch(kept, arrow)
                kept = []
        if kept:
            yield _batch(kept, arrow)
        pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, out)


def attach(df: DataFrame, reads: list[str], make: Callable[[], Callable[[list[tuple]], list[tuple]]], adds: str, less: tuple[str, ...] = ()) -> DataFrame:
    """df with columns added that a function gives for slices of rows, and without those of less.

    make is called once in each task; its function takes the tuples of the columns read and gives
    as many tuples of the columns added. The other columns pass through as they are.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    added = spark.createDataFrame([], adds).schema
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in added.fields])
    at, kept = [df.columns.index(c) for c in reads], [i for i, c in enumerate(df.columns) if c not in less]
    names = [df.columns[i] for i in kept] + added.names
    schema = StructType([df.schema.fields[i] for i in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                new = fn(list(zip(*(part.column(i).to_pylist() for i in at), strict=True)))
                own = [pa.array(list(c), f.type) for c, f in zip(zip(*new, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + own, names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """For work that makes many small objects and no reference cycles: the collector waits."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
