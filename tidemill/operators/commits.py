"""Changes to several tables that succeed or fail as one."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemill.storage import claim, names, read_text, remove, rename, write_text


class Conflict(RuntimeError):
    """Another change has been committed since this one began."""


class Store:
    """Tables under one path. A manifest names the version of each that holds; the last manifest counts.

    A version is a folder that is written once. A change writes new versions and then one manifest, which
    is renamed into place, so readers see all of the change or nothing. What a change wrote that fails,
    or that is a dry run, is deleted, and the manifest stays as it was. Readers that hold an earlier
    version may go on reading until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> tuple[int, dict[str, str]]:
        """The number of the last manifest, 0 before the first, and the version of each table."""
        last = max((int(n) for n in names(self.spark, f"{self.path}/manifest") if n.isdigit()), default=0)
        return last, json.loads(read_text(self.spark, f"{self.path}/manifest/{last}")) if last else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{self.state()[1][name]}")

    @contextlib.contextmanager
    def change(self, dry: bool = False) -> Iterator[Change]:
        """A change that is committed at the end; dry runs and errors leave the tables as they were."""
        c = Change(self)
        try:
            yield c
            if not dry:
                c.commit()
        finally:
            if not c.committed:
                for name, version in c.written:
                    remove(self.spark, f"{self.path}/{name}/{version}")

    def vacuum(self) -> int:
        """Deletes the versions that no longer hold, of changes that are through, and says how many."""
        gone, held = 0, self.state()[1]
        for name in held:
            for version in names(self.spark, f"{self.path}/{name}"):
                if version != held[name]:
                    remove(self.spark, f"{self.path}/{name}/{version}")
                    gone += 1
        return gone


class Change:
    def __init__(self, store: Store):
        self.store, self.committed, self.written = store, False, []
        self.number, self.versions = store.state()

    def read(self, name: str) -> DataFrame:
        """A table as this change leaves it so far."""
        return self.store.spark.read.parquet(f"{self.store.path}/{name}/{self.versions[name]}")

    def write(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        self.written.append((name, version))
        df.write.parquet(f"{self.store.path}/{name}/{version}")
        self.versions = self.versions | {name: version}

    def commit(self) -> None:
        """Puts the new manifest in place; raises Conflict if another change was faster."""
        spark, at = self.store.spark, f"{self.store.path}/manifest"
        if self.store.state()[0] != self.number or not claim(spark, f"{at}/_{self.number + 1}"):
            raise Conflict(f"manifest {self.number + 1} is taken")
        write_text(spark, f"{at}/_{self.number + 1}.new", json.dumps(self.versions))
        rename(spark, f"{at}/_{self.number + 1}.new", f"{at}/{self.number + 1}")
        self.committed = True
