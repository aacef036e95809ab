"""The bucketed store: merges, what is rewritten, writers at once, replays; streams that keep it."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from siftwork.operators import index, search
from siftwork.operators.store import Store
from siftwork.streaming.index import keep_indexed, keep_savings

SCHEMA = "k string, n long, t long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), frame(spark, []).schema, ["k"], 8)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(store):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{store.path}/data") for f in fs if f.endswith(".parquet")}


def test_sets_merge_by_key(spark, store):
    assert rows_of(store.read()) == [] and store.version() == 0
    base = [(f"k{i}", i, 1) for i in range(200)] + [(None, -1, 1)]
    store.replace(frame(spark, base))
    want = {k: [(k, n, t)] for k, n, t in base}
    store.replace(frame(spark, [("k3", 30, 2), ("k3", 31, 2), ("new", 5, 2)]))
    want |= {"k3": [("k3", 30, 2), ("k3", 31, 2)], "new": [("new", 5, 2)]}
    store.delete(frame(spark, [("k4", 0, 0), (None, 0, 0), ("not there", 0, 0)]))
    want.pop("k4"), want.pop(None)
    store.upsert(frame(spark, [("k5", 50, 0), ("k6", 60, 9), ("k6", 61, 8), ("k4", 44, 3)]), F.struct("t", "n"))
    want |= {"k6": [("k6", 60, 9)], "k4": [("k4", 44, 3)]}  # k5 has a later row
    assert rows_of(store.read()) == sorted((r for rs in want.values() for r in rs), key=str)
    assert rows_of(store.lookup(frame(spark, [("k3", 0, 0), ("k9", 0, 0), ("k3", 0, 0), ("gone", 0, 0)]))) == [("k3", 30, 2), ("k3", 31, 2), ("k9", 9, 1)]
    assert rows_of(store.read(1)) == sorted(base, key=str)
    before = rows_of(store.read())
    assert store.compact(2) and rows_of(store.read()) == before and store.compact(2) == []
    assert store.vacuum(1) >= 3 and rows_of(store.read()) == before


def test_only_changed_buckets_are_written(spark, store):
    store.replace(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("n"), F.lit(1).cast("long").alias("t")))
    first = files(store)
    assert len(first) == 8
    store.replace(frame(spark, [("k1", 0, 2), ("k2", 0, 2)]))
    added = files(store) - first
    assert first <= files(store) and len(added) <= 2 and sum(map(os.path.getsize, added)) < 20_000
    touched = {f.split("_bucket=")[1].split("/")[0] for f in added}
    assert {str(b) for b in store.compact(2)} == touched
    rewritten = files(store) - first - added
    assert {f.split("_bucket=")[1].split("/")[0] for f in rewritten} == touched and len(rewritten) == len(touched)
    store.vacuum(1)
    # of the first set, the buckets that were not touched are still in use
    assert rows_of(store.lookup(frame(spark, [("k1", 0, 0), ("k7", 0, 0)]))) == [("k1", 0, 2), ("k7", 7, 1)] and store.read().count() == 20_000


def test_twelve_writers_lose_nothing(spark, store):
    failed = []

    def write(w):
        try:
            mine = Store(spark, store.path, store.schema, ["k"], 8)
            for j in range(2):
                mine.replace(frame(spark, [(f"w{w}-{j}", w, j)]))
            if w % 4 == 0:
                mine.compact(2)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert rows_of(store.read()) == sorted((f"w{w}-{j}", w, j) for w in range(12) for j in range(2))


def test_a_repeated_batch_changes_nothing(spark, store):
    store.replace(frame(spark, [("a", 1, 1)]), "s", 0)
    store.add_up(frame(spark, [("a", 2, 1), ("b", 5, 5)]), ["n", "t"], "sums", 0)
    once = store.version()
    assert store.add_up(frame(spark, [("a", 2, 1)]), ["n", "t"], "sums", 0) == once and store.replace(frame(spark, [("a", 9, 9)]), "s", 0) == once
    assert rows_of(store.read()) == [("a", 3, 2), ("b", 5, 5)]
    store.add_up(frame(spark, [("a", 1, 0)]), ["n", "t"], "sums", 1)
    assert rows_of(store.read()) == [("a", 4, 2), ("b", 5, 5)]


def test_expiry(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01")], "k string, d string").select("k", F.col("d").cast("timestamp").alias("updated_at"))
    kept = Store(spark, str(tmp_path / "s"), rows.schema, ["k"], 2)
    kept.replace(rows)
    import datetime

    kept.expire(datetime.datetime(2024, 3, 5), 30, "updated_at")
    assert rows_of(kept.read()) == rows_of(index.expire(rows, datetime.datetime(2024, 3, 5), 30)) and kept.read().count() == 1


def test_continuous_index_is_idempotent(spark, tmp_path):
    source, place, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    put = lambda rows: spark.createDataFrame(rows, "file_path string, text string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("file_path string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    put([("a.py", "import fishing\nx = fishing(1)"), ("b.py", "# fishing\nnothing")])
    put([("c.py", "finishing touches")])
    kept = keep_indexed(stream(), place, state, gathered=2)
    found = lambda: sorted((r["file_path"], r["line"], r["name"]) for r in search.like(kept.read(), "shing", None).collect())
    assert found() == [("a.py", 1, "fishing"), ("a.py", 2, "fishing"), ("c.py", 1, "finishing")]
    put([("a.py", "washing"), ("c.py", None)])
    version = keep_indexed(stream(), place, state).version()
    assert found() == [("a.py", 1, "washing")]
    # a stream whose state is lost takes all batches again, and a batch that is known is not applied
    assert keep_indexed(stream(), place, str(tmp_path / "other state")).version() == version and found() == [("a.py", 1, "washing")]


def test_lines_are_made_where_they_are_written(spark, tmp_path, monkeypatch):
    """Of an index, texts are shuffled once, not their lines and words; nor are these sorted by bucket."""
    from siftwork.operators import store as stores
    from siftwork.streaming.index import keep_indexed

    plans, write = [], stores.Store._write

    def seen(self, rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(self, rows)

    monkeypatch.setattr(stores.Store, "_write", seen)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    frame = spark.createDataFrame([("a", "one two\n# no\nthree"), ("a", "one"), ("b", None), (None, "four")], "file_path string, text string")
    frame.write.parquet(f"{tmp_path}/in")
    kept = keep_indexed(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", f"{tmp_path}/state")
    assert sorted(map(str, ((r["file_path"], r["line"], r["name"]) for r in kept.read().collect()))) == sorted(map(str, [("a", 1, "one"), ("a", 1, "two"), ("a", 3, "three"), (None, 1, "four")]))
    (plan,) = plans
    assert 0 <= plan.index("Generate posexplode") < plan.index("Repartition") and plan.count("Generate posexplode") == 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_savings_are_summed_once(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "sums")
    for k in range(3):
        spark.createDataFrame([("read", 100, 10 + k), ("diff", 50, 5), ("read", 1, 5)], "category string, original long, optimized long").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("category string, original long, optimized long").option("maxFilesPerTrigger", 1).parquet(source)
    kept = keep_savings(stream(), place, str(tmp_path / "state"))
    once = rows_of(kept.read())
    assert [r[0] for r in once] == ["diff", "read"] and once[0][1:3] == (150, 15)
    assert rows_of(keep_savings(stream(), place, str(tmp_path / "again")).read()) == once
