"""Tables in the folder that driver and executors share: intermediates, and tables that are kept."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a folder of this machine is set in its place if driver and executors are
    one process (tests); on a cluster a folder of one machine would lose rows, so that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes for each core between which a table that comes in few files is dealt over all cores.
DEALT_BYTES = 256 << 10, 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of files, dealt over all cores if it is small and comes in fewer files than there are cores.

    A file of one row group is read by one task, however many cores wait. Beyond the upper bound the
    table stays as it lies: its files are split, and dealing it would move too much.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    low, high = (b * cores for b in DEALT_BYTES)
    return df.repartition(cores) if low <= size <= high and len(df.inputFiles()) < cores else df


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES at most, unless the session sets its own bound."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Settled tables that still stand, with their sessions, and the open scopes that own some of them.
_TABLES: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that goes when its scratch scope or the process ends."""
    at = f"{shared_dir(spark)}/tidemill-{label}-{uuid.uuid4().hex}"
    _TABLES[at] = spark
    if _SCOPES:
        _SCOPES[-1].append(at)
    return at


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """What is settled inside stays until it is released or the process ends, whatever scope is around."""
    open_scopes = _SCOPES[:]
    _SCOPES.clear()
    try:
        yield
    finally:
        _SCOPES[:] = open_scopes


def stamp(df: DataFrame) -> tuple:
    """The files of a table with their lengths and times: what changes when the table does."""
    out = []
    for name in sorted(df.inputFiles()):
        files, path = _hadoop(df.sparkSession, name)
        status = files.getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts the lineage.

    A lost executor costs the tasks that read this table, not the stages before it. The table
    goes when it is released, when the scratch scope around it ends, or when the process ends.
    """
    at = fresh_path(df.sparkSession, label)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._settled_at = at
    return out


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, at: str) -> bool:
    files, path = _hadoop(spark, at)
    return files.exists(path)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes what is at a path, if anything is."""
    files, path = _hadoop(spark, at)
    files.delete(path, True)


def names(spark: SparkSession, at: str) -> list[str]:
    """What stands in a folder; nothing if it isn't there."""
    files, path = _hadoop(spark, at)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def claim(spark: SparkSession, at: str) -> bool:
    """Makes an empty file; false if it is there."""
    files, path = _hadoop(spark, at)
    return files.createNewFile(path)


def rename(spark: SparkSession, at: str, to: str) -> None:
    files, path = _hadoop(spark, at)
    if not files.rename(path, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {at} to {to}")


def write_text(spark: SparkSession, at: str, text: str) -> None:
    files, path = _hadoop(spark, at)
    out = files.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, at: str) -> str:
    files, path = _hadoop(spark, at)
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _delete(at: str) -> None:
    spark = _TABLES.pop(at, None)
    if spark is not None and spark._jvm is not None:
        remove(spark, at)


def release(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        if at := getattr(df, "_settled_at", None):
            _delete(at)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at the end, save those handed to the yielded function."""
    own: list[str] = []
    _SCOPES.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df._settled_at)
        return df

    try:
        yield keep
    finally:
        _SCOPES.remove(own)
        for at in own:
            _delete(at)


@atexit.register
def _clear() -> None:
    for at in list(_TABLES):
        with contextlib.suppress(Exception):  # the session may be gone before
            _delete(at)
