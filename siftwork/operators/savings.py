"""Rollups of tokens saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dollars

#: The categories that savings are told by.
CATEGORIES = ("skeleton", "slice", "cache", "repo_map", "command", "symbol_search", "lockfile")

#: How an assumed raw cost follows from the tokens returned: factor, least, most.
ASSUMED = {"symbol_search": (3, 150, 1500), "references": (3, 200, 2000), "repo_map": (1, 1500, 5000)}


def valid(savings: DataFrame) -> DataFrame:
    return savings.filter("original > 0").withColumn("saved", F.greatest(F.lit(0), F.col("original") - F.col("optimized")))


def by_category(savings: DataFrame) -> DataFrame:
    """category, original, optimized, saved, count, saved_pct of savings (category, original, optimized); other categories only count in totals()."""
    sums = valid(savings).filter(F.col("category").isin(*CATEGORIES)).groupBy("category").agg(
        F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("count")
    )
    return sums.withColumn("saved_pct", F.round(F.greatest(F.lit(0.0), F.col("saved") / F.col("original") * 100), 6))


def totals(savings: DataFrame) -> DataFrame:
    """One row: sums over all events, the percentage over known categories (over all, if there are none), and dollars."""
    known = F.col("category").isin(*CATEGORIES)
    sums = valid(savings).agg(
        F.coalesce(F.sum("original"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("optimized"), F.lit(0)).alias("optimized"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
        F.coalesce(F.sum(F.when(known, F.col("original"))), F.lit(0)).alias("_original"),
        F.coalesce(F.sum(F.when(known, F.col("saved"))), F.lit(0)).alias("_saved"),
        F.count(F.lit(1)).alias("count"),
    )
    pct = F.when(F.col("_original") > 0, F.col("_saved") / F.col("_original") * 100).when(F.col("original") > 0, F.col("saved") / F.col("original") * 100).otherwise(F.lit(0.0))
    return sums.select("original", "optimized", "saved", "count", F.round(pct, 6).alias("saved_pct"), F.round(dollars("saved"), 6).alias("dollars"))


def estimated_original(sizes: DataFrame, cap: int, low: int, high: int, by: str) -> DataFrame:
    """by, original: an assumed raw cost, a size / 3.5 for each file up to cap, their sum between low and high; not measured."""
    each = F.least((F.col("size") / 3.5).cast("long"), F.lit(cap))
    return sizes.groupBy(by).agg(F.least(F.greatest(F.sum(each), F.lit(low)), F.lit(high)).cast("long").alias("original")).withColumn("estimated", F.lit(True))


def assumed_original(tokens: Column, kind: str) -> Column:
    """The raw cost that is assumed for an answer of so many tokens; not measured."""
    factor, low, high = ASSUMED[kind]
    return F.greatest(F.lit(low), F.least(F.lit(high), tokens * factor)).cast("long")
