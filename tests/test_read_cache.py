"""The read cache as state: expiry between micro-batches, timers, a start from stored entries, publishing."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftwork.operators.reads import CHANGED, FIRST, UNCHANGED
from siftwork.operators.store import Store
from siftwork.streaming import cache

SCHEMA = "key string, read_ord long, at timestamp, content string"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


@pytest.fixture
def stream(spark, tmp_path):
    from siftwork.shipping import ship

    ship(spark)

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, **how):
        reads = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with cache.rocksdb(spark):
            q = cache.cached_reads(reads, **how).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        rows = spark.read.schema(cache.RESULT).parquet(str(tmp_path / name / "out")).collect()
        return sorted((r["key"], r["read_ord"], r["read_no"], r["status"]) for r in rows), cache.entries(spark, str(tmp_path / name / "state"))

    return put, run


def test_entries_expire_by_the_reads_own_times(stream):
    put, run = stream
    put([("a", 1, at(0), "x"), ("a", 2, at(1), "x"), ("b", 3, at(1), "y"), ("c", 4, at(1), None)])
    put([("a", 5, at(3), "z"), ("b", 6, at(4), "y"), ("c", 7, at(2), None)])
    put([("d", 8, at(30), "q")])
    put([("d", 9, at(31), "q"), ("a", 10, at(31), "z")])
    got, entries = run("one", keep="2 hours")
    assert got == [("a", 1, 1, FIRST), ("a", 2, 2, UNCHANGED), ("a", 5, 3, CHANGED), ("a", 10, 1, FIRST), ("b", 3, 1, FIRST), ("b", 6, 1, FIRST), ("c", 4, 1, FIRST), ("c", 7, 2, UNCHANGED), ("d", 8, 1, FIRST), ("d", 9, 2, UNCHANGED)]
    # timers have removed what was not read again
    assert {r["key"] for r in entries.collect()} == {"a", "d"}


def test_a_stream_starts_from_stored_entries(spark, stream, tmp_path):
    put, run = stream
    put([("a", 1, at(0), "x"), ("b", 2, at(0), "y"), ("b", 3, at(1), "y")])
    _, entries = run("one")
    stored = Store(spark, str(tmp_path / "cache"), entries.schema, ["key"], 2)
    stored.replace(entries)
    put([("a", 4, at(2), "x"), ("c", 5, at(2), "x")])
    got, after = run("two", start=stored.read())
    assert [r for r in got if r[1] > 3] == [("a", 4, 3, UNCHANGED), ("c", 5, 1, FIRST)]
    assert [r for r in got if r[1] <= 3] == [("a", 1, 2, UNCHANGED), ("b", 2, 3, UNCHANGED), ("b", 3, 4, UNCHANGED)]
    stored.replace(after)
    assert {r["key"]: r["read_no"] for r in stored.read().collect()} == {"a": 3, "b": 4, "c": 1}
    expired, _ = run("three", start=stored.read().withColumn("last_us", F.lit(0).cast("long")), keep="2 hours")
    assert expired[0] == ("a", 1, 1, FIRST)


def test_keys_of_a_bucket_share_a_group(spark, stream, tmp_path, monkeypatch):
    put, run = stream
    monkeypatch.setattr(cache, "BUCKETS", 2)
    name, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "7")  # a bucket's reads and entries come in several batches
    try:
        put([(f"k{i % 20}", i, at(i / 10), f"{i // 40}") for i in range(100)])
        first, entries = run("one")
        held = spark.read.format("statestore").option("path", str(tmp_path / "one" / "state")).option("stateVarName", cache.STATE).load()
        assert held.select("key").distinct().count() == 2 and entries.count() == 20
        again, _ = run("two", start=entries)
        put([("k3", 200, at(30), "x")])
        put([("k3", 201, at(31), "x"), ("k4", 202, at(31), None)])
        _, after = run("three", keep="3 hours")
    finally:
        spark.conf.set(name, was)
    status = lambda i: FIRST if i < 20 else CHANGED if i // 40 != (i - 20) // 40 else UNCHANGED
    assert first == sorted((f"k{i % 20}", i, i // 20 + 1, status(i)) for i in range(100))
    assert again == sorted((f"k{i % 20}", i, i // 20 + 6, CHANGED if i < 20 else status(i)) for i in range(100))
    # a bucket's timer leaves the entries whose time has not come
    assert {(r["key"], r["read_no"]) for r in after.collect()} == {("k3", 2), ("k4", 1)}
