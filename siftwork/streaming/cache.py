"""The read cache as keyed state that expires, starts from a stored cache and is published back to it."""

from __future__ import annotations

import contextlib
import itertools
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reads import CHANGED, FIRST, UNCHANGED

RESULT = "key string, read_ord long, read_no long, status string"
#: A key's last content, how often it was read since it was new, and when it was read last (microseconds).
KEY, ENTRY = "key string", "hash string, read_no long, last_us long"
STATE = "cache"
#: Keys are handled by groups of one hash, as each group costs a task some milliseconds. A checkpoint holds for one number of groups.
BUCKETS = 1024


# Spark starts a processor on the driver, too, in a worker that does not get the package: so it is sent by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ReadCache(StatefulProcessor):
    """Statuses of the reads of a bucket of keys; a key's entry expires keep_us after its last read, by the reads' own times.

    Contents are hashed before they come here, so a micro-batch holds a digest a read. Entries are read and written by
    key. A timer at a bucket's first expiry deletes the entries of keys that are not read again, once the watermark has
    passed their expiry; a key that is read later than its expiry is new, whether or not its timer has come.
    """

    def __init__(self, keep_us: int | None):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState(STATE, KEY, ENTRY)

    def _expiry(self, last_us: int) -> int:
        return (last_us + self.keep_us) // 1000 + 1

    def _wake(self, lasts: list[int], timers) -> None:
        """Sets the bucket's timer to the first expiry of entries that were read last at these times, if it is not earlier."""
        lasts = [x for x in lasts if x is not None]
        if not self.keep_us or not lasts:
            return
        # of a late read, the watermark may have passed the expiry already
        first, now = max(self._expiry(min(lasts)), timers.getCurrentWatermarkInMs() + 1), list(self.handle.listTimers())
        if not now or first < min(now):
            for at in now:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["key", "read_ord"], kind="stable")
        out, lasts = [], []
        for name, reads in itertools.groupby(zip(*(table[c].tolist() for c in ("key", "read_ord", "at_us", "hash"))), lambda r: r[0]):
            known, n, last = self.entries.getValue((name,)) or (None, 0, None)
            for _, order, us, digest in reads:
                us = last if us != us else int(us)  # a read without a time is as old as the one before
                if n and self.keep_us and None not in (us, last) and us - last > self.keep_us:
                    n = 0
                n += 1
                out.append((name, order, n, FIRST if n == 1 else UNCHANGED if digest == known else CHANGED))
                known, last = digest, us
            self.entries.updateValue((name,), (known, n, last))
            lasts.append(last)
        self._wake(lasts, timerValues)
        yield pd.DataFrame(out, columns=["key", "read_ord", "read_no", "status"], dtype=object)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.astype(object).where(initialState.notna(), None)
        for name, *entry in zip(*(rows[c].tolist() for c in ("key", "hash", "read_no", "last_us"))):
            self.entries.updateValue((name,), tuple(entry))
        self._wake(rows["last_us"].tolist(), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(k, last) for k, (_, _, last) in self.entries.iterator() if last is not None]
        gone = {k for k, last in held if self._expiry(last) <= timerValues.getCurrentWatermarkInMs()}
        for k in gone:
            self.entries.removeKey(k)
        left = [self._expiry(last) for k, last in held if k not in gone]
        if left:
            self.handle.registerTimer(min(left))
        yield pd.DataFrame(columns=["key", "read_ord", "read_no", "status"], dtype=object)

    def close(self) -> None:
        pass


def cached_reads(reads: DataFrame, keep: str | None = None, delay: str = "0 seconds", start: DataFrame | None = None) -> DataFrame:
    """key, read_ord, read_no, status of a stream of reads (key, read_ord, at: timestamp, content).

    keep: an interval after a key's last read when its entry expires. start: entries (key, hash, read_no, last_us) that the
    stream's first batch begins with, as entries() gives them. Reads of one micro-batch are taken in order of read_ord.
    The session's state store has to be RocksDB: start it inside rocksdb().
    """
    spark = reads.sparkSession
    keep_us = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {keep}) - unix_micros(timestamp_micros(0))")).first()[0] if keep else None
    rows = reads.select("key", "read_ord", F.col("at").cast("timestamp").alias("at"), F.when(F.col("content").isNull(), "").otherwise(F.sha2("content", 256)).alias("hash"))
    rows = rows.withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    # of several entries of a key the last one counts
    first = None if start is None else start.groupBy("key").agg(F.max(F.struct("last_us", "read_no", "hash")).alias("e")).select(bucket, "key", "e.hash", "e.read_no", "e.last_us").groupBy("bucket")
    return rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(ReadCache(keep_us), RESULT, "Append", "EventTime", initialState=first)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, as this one needs."""
    name, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, hash, read_no, last_us: the entries that a stream with this checkpoint holds after its last batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    return rows.select("user_map_key.key", "user_map_value.hash", "user_map_value.read_no", "user_map_value.last_us")
