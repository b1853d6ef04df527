"""Rate limit and cache as streams against the fold of the whole table, over several batches."""

import random

import pytest

from tidemill.streaming import events, limits


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


SCHEMA = "call long, caller string, ts timestamp"


def batches(r, n=6):
    """Calls of some callers, in bursts, one batch after the other."""
    at, call, out = 1_700_000_000, 0, []
    for _ in range(n):
        rows = []
        for _ in range(60):
            at += r.choice([0, 0, 1, 2, 9])
            call += 1
            rows.append((call, r.choice("abc"), at))
        out.append(rows)
        at += r.choice([0, 70])
    return out


def run(spark, tmp_path, parts, make):
    """Feeds the parts as files one batch each, restarting the stream half-way, and gives all its rows."""
    source, rows = str(tmp_path / "in"), []
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "call long, caller string, s long").selectExpr("call", "caller", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(source)
        if k % 2 and k != len(parts) - 1:
            continue
        stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(rows), source


@pytest.mark.parametrize("kind", ["limit", "cache"])
def test_stream_equals_the_fold(rocks, tmp_path, kind):
    parts = batches(random.Random(kind))
    stream, fold = (limits.limited, events.rate_limited) if kind == "limit" else (limits.cached, events.cache_hits)
    own = (4, 20.0) if kind == "limit" else (20.0,)
    got, source = run(rocks, tmp_path, parts, lambda s: stream(s, "caller", "ts", "call", *own))
    want = fold(rocks.read.parquet(source), "caller", "ts", "call", *own)
    assert got == sorted(map(tuple, want.collect())) and len({x[2] for x in got}) == 2


def test_expired_state_is_gone(rocks, tmp_path):
    base = 1_700_000_000
    parts = [[(1, "a", base), (2, "a", base + 1)], [(3, "b", base + 500)], [(4, "b", base + 501)]]
    got, _ = run(rocks, tmp_path, parts, lambda s: limits.limited(s, "caller", "ts", "call"))
    assert got == [("a", 1, True), ("a", 2, True), ("b", 3, True), ("b", 4, True)]
    state = rocks.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "cp"))
    assert {r.key[0] for r in state.select("key").collect()} == {"b"}  # the timer of a has cleared its times
