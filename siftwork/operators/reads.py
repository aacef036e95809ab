"""Repeated reads of the same keys: first, unchanged or changed; batch form. streaming/reads.py has the same for streams."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import content_hash, est_chars4
from ..shipping import bounded_batches

#: Lines of context of a diff; longer contents are kept as a hash only, so they cannot be diffed.
CONTEXT_LINES, MOST_KEPT = 3, 5 * 1024 * 1024
FIRST, UNCHANGED, CHANGED = "FIRST_READ", "UNCHANGED", "CHANGED"


def statuses(reads: DataFrame, key: str = "key", order: str = "read_ord", content: str = "content") -> DataFrame:
    """reads with read_no and status, each by the key's read before."""
    by = Window.partitionBy(key).orderBy(order)
    rows = reads.withColumn("_hash", content_hash(content)).withColumn("read_no", F.row_number().over(by))
    before = F.lag("_hash").over(by)
    return rows.withColumn("status", F.when(F.col("read_no") == 1, FIRST).when(before.eqNullSafe(F.col("_hash")), UNCHANGED).otherwise(CHANGED)).drop("_hash")


def unified_diff(old: str | None, new: str | None, context: int = CONTEXT_LINES) -> str | None:
    """None if either text is not known."""
    if old is None or new is None:
        return None
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), "original", "modified", n=context))


@F.pandas_udf(StringType())
def _diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(a, b) for a, b in zip(old, new)], dtype=object)


def smallest_text(status, content, diff):
    """What a read returns: nothing if unchanged, the diff if it is smaller than the text, else the text."""
    return F.when(status == UNCHANGED, F.lit(None)).when((status == CHANGED) & diff.isNotNull() & (F.length(diff) < F.length(content)), diff).otherwise(content)


def read_results(reads: DataFrame, key: str = "key", order: str = "read_ord", content: str = "content") -> DataFrame:
    """reads with read_no, status, text, orig_tokens, opt_tokens. Only changed rows reach the diff."""
    bounded_batches(reads.sparkSession)
    by = Window.partitionBy(key).orderBy(order)
    rows = statuses(reads, key, order, content).withColumn("_before", F.lag(content).over(by))
    kept = lambda c: F.when(F.length(c) <= MOST_KEPT, F.col(c))
    old, new = F.when(F.col("status") == CHANGED, kept("_before")), F.when(F.col("status") == CHANGED, kept(content))
    rows = rows.withColumn("_diff", _diff(old, new)).withColumn("text", smallest_text(F.col("status"), F.col(content), F.col("_diff")))
    return rows.withColumn("orig_tokens", est_chars4(content)).withColumn("opt_tokens", F.coalesce(est_chars4("text"), F.lit(0))).drop("_before", "_diff")


def read_stats(read: DataFrame) -> DataFrame:
    """One row: reads, first_reads, hits, diffs, hit_rate."""
    sums = read.agg(F.count(F.lit(1)).alias("reads"), *(F.count_if(F.col("status") == s).alias(n) for s, n in ((FIRST, "first_reads"), (UNCHANGED, "hits"), (CHANGED, "diffs"))))
    return sums.withColumn("hit_rate", F.round(F.when(F.col("reads") > 0, F.col("hits") / F.col("reads")).otherwise(F.lit(0.0)), 6))


def changed_symbols(old: DataFrame, new: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, changed: the first symbols (key, name, hash, ord) that are new or whose hash is another; of a name that repeats, the last counts."""
    last = lambda t: t.groupBy(key, "name").agg(F.max_by("hash", "ord").alias("hash"), F.min("ord").alias("ord"))
    met = last(new).join(last(old).select(key, "name", F.col("hash").alias("_old")), [key, "name"], "left").filter(~F.col("hash").eqNullSafe(F.col("_old")))
    return met.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, most), lambda x: x["name"]).alias("changed"))


def with_focus(diff: Column, changed: Column) -> Column:
    """The diff with the names that changed in a line before it; as it is if there are none."""
    return F.when(F.size(changed) > 0, F.concat(F.lit("[SEMANTIC FOCUS: "), F.array_join(changed, ", "), F.lit("]\n"), diff)).otherwise(diff)
