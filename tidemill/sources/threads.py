"""The comments of the latest threads as a stream: offsets are threads and pages read of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemill.sources.fetch import ATTEMPTS, get_json

#: How many threads are followed.
THREADS = 2


class _Page(InputPartition):
    def __init__(self, thread: str, page: int, take: int | None):
        self.thread, self.page, self.take = thread, page, take


class _Reader(DataSourceStreamReader):
    """An offset holds how many pages of each thread are read; a page that was read is never asked for again."""

    def __init__(self, options: dict):
        self.search, self.page = options["search"], options["page"]
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.limit, self.size = int(options.get("limit", 0)), int(options.get("pagesize", 20))

    def _get(self, thread: str, page: int) -> dict:
        return get_json(self.page.replace("{thread}", thread).replace("{page}", str(page)), attempts=self.attempts)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """All pages that the latest threads have now, the newest thread first, as far as the limit goes."""
        hits = get_json(self.search, attempts=self.attempts).get("hits") or []
        newest = sorted((h for h in hits if h.get("objectID")), key=lambda h: int(h.get("created_at_i") or 0), reverse=True)
        left, out = -(-self.limit // self.size) if self.limit else None, {}
        for thread in [str(h["objectID"]) for h in newest[:THREADS]]:
            pages = int(self._get(thread, 0).get("nbPages") or 0)
            out[thread] = pages if left is None else min(pages, left)
            left = None if left is None else left - out[thread]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task for each page that is new. The limit holds for all pages of a run over both threads."""
        pages = [(t, p) for t, n in end.items() for p in range(start.get(t, 0), n)]
        whole = sum(end.values())
        last = (whole * self.size - self.limit) if self.limit else 0
        cut = next((t for t, n in reversed(end.items()) if n), None)
        return [_Page(t, p, self.size - last if last > 0 and t == cut and p == end[t] - 1 else None) for t, p in pages]

    def read(self, partition: _Page) -> Iterator[tuple]:
        hits = self._get(partition.thread, partition.page).get("hits") or []
        for h in hits[: partition.take]:
            yield partition.thread, partition.page, str(h.get("objectID")), json.dumps(h, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass


class ThreadSource(DataSource):
    """spark.readStream.format("threads").option("search", ...).option("page", ".../{thread}/{page}").load()"""

    @classmethod
    def name(cls) -> str:
        return "threads"

    def schema(self) -> str:
        return "thread string, page int, id string, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def threads(spark: SparkSession, search: str, page: str, limit: int = 0, page_size: int = 20) -> DataFrame:
    """(thread, page, id, payload) of the comments of the latest threads, as a stream.

    search gives {"hits": [{"objectID", "created_at_i"}]}, and page with {thread} and {page} gives
    {"nbPages", "hits"}. With a limit so many comments over all threads are read, the newest thread's first.
    """
    spark.dataSource.register(ThreadSource)
    return spark.readStream.format("threads").option("search", search).option("page", page).option("limit", limit).option("pageSize", page_size).load()
