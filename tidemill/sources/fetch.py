"""Fetching of JSON by address with retries, and a data source that reads boards in parallel."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Attempts of a request, seconds before the second one (each wait is twice the last), and the longest wait.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 60.0
AGENT = {"User-Agent": "tidemill"}


def retry_wait(header: str | None, fallback: float, now: datetime | None = None) -> float:
    """Seconds that a Retry-After header asks for, as a number or a date, within 0 and LONGEST_WAIT.

    The fallback stands for what is missing or can't be read.
    """
    try:
        wait = float(header)
    except (TypeError, ValueError):
        try:
            at = parsedate_to_datetime(header or "")
        except (TypeError, ValueError):
            return fallback
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        wait = (at - (now or datetime.now(UTC))).total_seconds()
    return min(max(wait, 0.0), LONGEST_WAIT) if wait == wait else fallback


def open_url(address: str) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body; only transport errors raise."""
    try:
        with urllib.request.urlopen(urllib.request.Request(address, headers=AGENT), timeout=30) as r:  # noqa: S310
            return getattr(r, "status", None) or 200, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


def get_json(address: str, params: dict[str, str] | None = None, attempts: int = ATTEMPTS, opener: Callable = open_url, sleep: Callable[[float], None] = time.sleep):
    """The JSON at an address. Statuses 429 and 5xx and transport errors are tried again, others fail at once."""
    if params:
        address += ("&" if "?" in address else "?") + urllib.parse.urlencode(params)
    wait, last = FIRST_WAIT, ""
    for attempt in range(attempts):
        header = None
        try:
            status, headers, body = opener(address)
        except OSError as e:
            last = str(e)
        else:
            if status < 300:
                return json.loads(body)
            last = f"status {status}"
            if status != 429 and status < 500:
                raise RuntimeError(f"{address}: {last}")
            header = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
        if attempt + 1 < attempts:
            sleep(retry_wait(header, wait))
            wait *= 2
    raise RuntimeError(f"{address}: {last} after {attempts} attempts")


class _Board(InputPartition):
    def __init__(self, slug: str, address: str):
        self.slug, self.address = slug, address


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Board(s, self.options["address"].replace("{slug}", s)) for s in self.options.get("slugs", "").split(",") if s]

    def read(self, partition: _Board) -> Iterator[tuple]:
        try:
            found = get_json(partition.address, attempts=int(self.options.get("attempts", ATTEMPTS)))
            yield partition.slug, json.dumps(found, ensure_ascii=False), None
        except (RuntimeError, ValueError) as e:  # one board's failure is a row, not the end of the job
            yield partition.slug, None, str(e)


class BoardSource(DataSource):
    """spark.read.format("boards").option("address", "https://.../{slug}").option("slugs", "a,b").load()"""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "slug string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def boards(spark: SparkSession, address: str, slugs: list[str], attempts: int = ATTEMPTS):
    """(slug, payload, error) of each board, one task a board."""
    spark.dataSource.register(BoardSource)
    return spark.read.format("boards").option("address", address).option("slugs", ",".join(slugs)).option("attempts", attempts).load()
