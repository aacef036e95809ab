"""The persistent index: incremental refresh, replacement by key, purge, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["project_root", "file_path"]


def to_refresh(files: DataFrame, meta: DataFrame) -> DataFrame:
    """files (project_root, file_path, file_hash, mtime) with action: `skip` (same time), `touch` (same content), `index`."""
    known = meta.select(*KEYS, F.col("file_hash").alias("_hash"), F.col("mtime").alias("_mtime"))
    action = F.when(F.col("_mtime") == F.col("mtime"), "skip").when(F.col("_hash") == F.col("file_hash"), "touch").otherwise("index")
    return files.join(known, KEYS, "left").withColumn("action", action).drop("_hash", "_mtime")


def purge(index: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of index whose file is still there."""
    return index.join(present.select(*KEYS).distinct(), KEYS, "left_semi")


def replace_by_key(index: DataFrame, fresh: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """index with all rows of the keys in fresh replaced by those of fresh."""
    return index.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(index.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by order, changes winning over equals."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}") for c in rest)).select(table.columns)


def expire(table: DataFrame, as_of, days: int, updated: str = "updated_at") -> DataFrame:
    """The rows that were updated within days before as_of."""
    return table.filter(F.col(updated) >= F.lit(as_of) - F.expr(f"interval {days} days"))


def evict(table: DataFrame, most: int, updated: str = "updated_at", tie: str = "path") -> DataFrame:
    """The most rows that were updated last."""
    return table.orderBy(F.desc(updated), tie).limit(most)


def invalidate(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def meta_of(index: DataFrame) -> DataFrame:
    """A file's hash and time: those of its latest row."""
    return index.groupBy(*KEYS).agg(F.max_by("file_hash", F.struct("mtime", "file_hash")).alias("file_hash"), F.max("mtime").alias("mtime"))


def row_counts(*tables: DataFrame) -> DataFrame:
    """One row: the rows of all tables together."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")) for t in tables]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.agg(F.sum("n").alias("rows"))


def project_roots(*tables: DataFrame) -> DataFrame:
    every = tables[0].select("project_root")
    for t in tables[1:]:
        every = every.unionByName(t.select("project_root"))
    return every.distinct()
