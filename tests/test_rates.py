"""Sliding rates on a stream, bucketed state of change capture, and changes of several tables."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import commits
from tidemill.streaming import events, rates

SCHEMA = "route string, status int, ts timestamp"


def test_sliding_rates_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    src, rows = str(tmp_path / "in"), []
    base = 1_700_000_000
    for n in range(4):
        part = [("ab"[i % 2], [200, 404, 500, 200][i % 4], base + n * 200 + i * 7) for i in range(30)]
        spark.createDataFrame(part, "route string, status int, s long").selectExpr("route", "status", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(src)
    kinds = {"client": F.col("status").between(400, 499), "server": F.col("status") >= 500}
    make = lambda df: rates.sliding(rates.panes(df, "ts", ["route"], kinds, late="5 minutes"), ["route"])
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in make(spark.read.parquet(src)).collect()}
    assert len(rows) == len(set(rows)) and len(rows) > 20
    assert set(rows) <= want  # windows that the watermark has passed, as they are in the table
    last = max(r[0] for r in rows)
    assert {r for r in want if r[0] <= last} == set(rows)


def test_counters_that_begin_anew(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 9.0), ("x", 3, 2.0), ("x", 4, 2.0), ("y", 1, 7.0)], "series string, ts int, v double")
    got = rates.increases(df, ["series"], "ts", "v").collect()
    assert sorted((r.series, r.ts, r.increase) for r in got) == [("x", 1, 0.0), ("x", 2, 4.0), ("x", 3, 2.0), ("x", 4, 0.0), ("y", 1, 0.0)]


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "out_latest" / "data"
    wrote = []
    for n, rows in enumerate([[(k, "A", k) for k in range(200)], [(3, "B", 1000)], [(3, "B", 1001), (4, "C", 1002)], [(3, "A", 1003)]]):
        spark.createDataFrame(rows, "k long, h string, seq long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k long, h string, seq long").parquet(src)
        events.capture_changes(stream, out, ["k"], "h", "seq", str(tmp_path / "cp"), buckets=16).awaitTermination()
        wrote.append({p.name for p in (state / f"epoch={n}").glob("_bucket=*")})
    assert sorted(r.seq for r in spark.read.parquet(out).where("seq >= 1000").collect()) == [1000, 1002, 1003]
    assert [len(w) for w in wrote] == [16, 1, 2, 1]
    left = [p.name for p in state.glob("epoch=*/_bucket=*")]
    assert len(set(left)) == 16 and len(left) <= 18  # the present buckets, and those a repeated batch would need


def test_a_change_holds_or_leaves_no_trace(spark, tmp_path):
    store = commits.Store(spark, f"file://{tmp_path}/s")
    with store.change() as c:
        c.write("a", spark.range(3))
        c.write("b", spark.range(5))
    number, held = store.state()
    assert number == 1 and store.read("a").count() == 3
    with pytest.raises(ZeroDivisionError), store.change() as c:  # between two writes
        c.write("a", spark.range(9))
        assert c.read("a").count() == 9 and store.read("a").count() == 3
        c.write("b", c.read("a").select((F.lit(1) / 0 if False else F.col("id")).alias("id")))
        raise ZeroDivisionError
    with pytest.raises(Exception), store.change() as c:  # in a write  # noqa: B017, PT011
        c.write("a", spark.range(9))
        c.write("b", spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id")))
    with store.change(dry=True) as c:
        c.write("a", spark.range(7))
        assert c.read("a").count() == 7
    assert store.state() == (number, held) and (store.read("a").count(), store.read("b").count()) == (3, 5)
    assert {p.name for p in (tmp_path / "s" / "a").iterdir() if not p.name.startswith(".")} == {held["a"]}
    with store.change() as c:
        c.write("a", spark.range(1))
    assert store.state()[1]["b"] == held["b"] and store.read("a").count() == 1
    assert store.vacuum() == 1 and store.read("b").count() == 5


def test_the_second_of_two_changes_is_refused(spark, tmp_path):
    store = commits.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(commits.Conflict), store.change() as slow:
        slow.write("a", spark.range(1))
        with store.change() as fast:
            fast.write("a", spark.range(2))
    assert store.read("a").count() == 2 and store.state()[0] == 1
