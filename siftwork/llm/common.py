"""Shared folder, written tables, hot-key joins and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space, as the contracts name it, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that holds at least one row in HOT_SHARE is hot; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse, unless that is a local folder of a cluster's driver."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir")
        if place.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {place} is local")
    return place.rstrip("/")


def _tables(spark: SparkSession) -> str:
    """This application's tables, which are deleted when the driver ends, or by clean()."""
    place = f"{shared_dir(spark)}/siftwork/{spark.sparkContext.applicationId}"
    if place not in _PLACES:
        _PLACES.add(place)
        atexit.register(_delete_at_exit, spark, place)
    return place


_PLACES: set[str] = set()


def _delete_at_exit(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(spark, place)


#: Folders inside which this thread writes tables now, the innermost last.
_SCRATCH: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scratch", default=())


def materialize(df: DataFrame, *partition_by: str, kept_as: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and no executor's loss costs it.

    kept_as: a name, under which the table outlives scratch folders until forget().
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{kept_as}" if kept_as else "/".join([_tables(spark), *_SCRATCH.get(), uuid.uuid4().hex])
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are deleted in the end; what depends on them has to be kept by a name before."""
    inside = (*_SCRATCH.get(), uuid.uuid4().hex)
    outer = _SCRATCH.set(inside)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        _delete(spark, "/".join([_tables(spark), *inside]))


def forget(spark: SparkSession, kept_as: str) -> None:
    _delete(spark, f"{_tables(spark)}/{kept_as}")


def clean(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; call it when the results are used up."""
    _delete(spark, _tables(spark))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on key, right having one row a key and weight rows of it on the left, total in all.

    Keys with total/HOT_SHARE rows or more, of which there are HOT_SHARE at most, are broadcast;
    the other keys are shuffled. So no task gathers a hot key.
    """
    least = max(1, -(-total // HOT_SHARE))
    hot, cold = right.filter(F.col(weight) >= least), right.filter(F.col(weight) < least)
    hot = F.broadcast(hot.limit(HOT_SHARE + 1))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, how))


#: Bits that by_bucket keeps for each wanted row, and the most it broadcasts (16 MB); with more wanted rows than MOST_BITS / 2 it passes all rows on.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 27


def by_bucket(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, how: str = "left_semi") -> DataFrame:
    """The rows whose key falls in a bucket of a wanted key (left_semi), or the others (left_anti). wanted is a written table.

    It goes before an exact join, so that only texts that a wanted key may mean are shuffled. Buckets are bits, as many as
    the counted wanted rows ask for, and are broadcast in words of 64, so that about one in BITS_EACH other rows passes.
    Beyond MOST_BITS / 2 wanted rows no bits are sent: left_semi gives all rows, left_anti none. A null key is in a bucket
    like any other.
    """
    count = wanted.count()
    if count > MOST_BITS // 2:
        return rows if how == "left_semi" else rows.limit(0)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (count * BITS_EACH).bit_length()))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(bucket(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bucket(c), F.lit(64)).cast("int"))
    met = wanted.groupBy(word(wanted_key).alias("_met_word")).agg(F.bit_or(bit(wanted_key)).alias("_met_bits"))
    found = rows.join(F.broadcast(met), word(key) == F.col("_met_word"), "inner" if how == "left_semi" else "left")
    inside = F.coalesce(F.col("_met_bits").bitwiseAND(bit(key)) != 0, F.lit(False))
    return found.filter(inside if how == "left_semi" else ~inside).drop("_met_word", "_met_bits")


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Readies the session for Python workers: they get this package, and Arrow batches are bounded by rows and bytes, as texts may be long.

    The bounds stay set, as a DataFrame runs later than it is made; bounds that are lower already are left.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).rstrip("bB").lstrip("-").isdigit() or not 0 < int(str(now).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives the memory that this Python worker has freed back to the system, as workers stay while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def numbered(table: DataFrame, by: list[str], order: list[str], place: str = "place") -> DataFrame:
    """table with place: 0, 1, ... inside each group of equal by columns (not null), in the order of the order columns.

    Rows are dealt by ranges of (by, order), so a group of any size lies in as many tasks as its rows need; a task numbers
    its own rows, and the counts of tasks and groups give each task its start. table is read twice, so it should be a
    written one. Rows equal in all of by and order lie in one task and are numbered in any order.
    """
    at, task = f"_{place}_at", f"_{place}_task"
    ends = [*by, *order]
    rows = table.repartitionByRange(*ends).sortWithinPartitions(*ends).withColumn(at, F.monotonically_increasing_id())
    rows = materialize(rows).withColumn(task, F.shiftright(at, 33))  # the upper bits are the task's number
    before = Window.partitionBy(*by).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, task).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*by, task, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, [task, *by]).withColumn(place, F.col(at) + F.col("_shift")).drop(at, task, "_shift")
