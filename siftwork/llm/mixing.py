"""Mixes sources to target weights: hash-random keys, range-sorted within a source, prefix sums, cuts at exact budgets.

Each row gets a hash-random key from its id, its text and a seed. Within a source, rows are ordered by that key; equal ranges of
the key space are buckets, whose sums give every bucket its place in the source's prefix sum, so no task holds a whole
source. A source whose target is e whole epochs and a rest takes every row e times and the first rows once more, to
the word: the row at the cut gives the words that are left. Only DataFrame functions are used.

Defined results: a null text has size 0 and is taken 0 times; null sources form one source, last in order; rows without
an id, and rows that share one, are told apart by their texts; rows equal in id and text have the same key, and which of
them is taken is decided by their other columns; a very long text may alone be a source's budget; columns source_size,
target and taken of sized are replaced; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Rows in a range of keys, over all sources; small tables have up to RANGES ranges of fewer rows, to spread over tasks.
RANGE_ROWS, RANGES, LEAST_ROWS = 20_000, 256, 500


def words(col: str = "text") -> Column:
    """The number of words: each begins where a word character follows white space or the start."""
    return F.size(F.regexp_extract_all(text_of(col), F.lit(WORD), F.lit(0))).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> with target: share of all sizes by weight, none above most times its source.

    Sources with the least most * size / weight are capped first; with the k first ones capped, the others get
    (all - caps) / weights of the others for each unit of weight. The right k is where that rate is highest.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = by_source.withColumn("_w", cycle.cast("long")).withColumn("_cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rate = (F.sum("source_size").over(every) * F.lit(share) - capped) / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    best = w.withColumn("_rate", rate).withColumn("_best", F.max("_rate").over(every))
    return best.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_best")).alias("target"))


def mark(col: str = "text") -> Column:
    """What tells texts apart in a row's key."""
    return F.md5(text_of(col))


def taken(sized: DataFrame, small: DataFrame, seed: str = SEED, whole: bool = False, **how) -> DataFrame:
    """sized (doc_id, source, size, mark; other columns stay) with source_size, target and taken. small: its four columns, written.

    whole: rows are taken whole, those at a cut if half of them is within. Rows equal in doc_id and mark are ordered by a
    column tie, if sized has one.
    """
    by_source = materialize(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), **how))
    rows = small.count()
    ranges = max(1, -(-rows // RANGE_ROWS), min(RANGES, rows // LEAST_ROWS))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark")).alias("_key")
    at = F.shiftrightunsigned(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges, 32)
    keys = ["_source", "_null", "_range"]

    def keyed(rows: DataFrame, *others: Column) -> DataFrame:
        rows = rows.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"), F.col("size").alias("_size"), key, *others)
        return rows.withColumn("_range", at)

    # rows are carried whole, so no column's name can clash
    carried = F.struct(*(F.col(f"`{c}`") for c in sized.columns if c not in ("source_size", "target", "taken"))).alias("_row")
    tie = F.col("tie") if "tie" in sized.columns else F.lit("")
    rows = keyed(sized, carried, tie.alias("_tie"))
    sums = keyed(small).groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_source", "_null").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    budgets = by_source.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"), "source_size", "target")
    starts = starts.join(budgets, ["_source", "_null"])
    within = Window.partitionBy(*keys).orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(starts, keys)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    if whole:
        part = F.when((F.col("_size") > 0) & (part * 2 >= F.col("_size")), F.col("_size")).otherwise(0)
    return placed.select("_row.*", "source_size", "target", (epochs * F.col("_size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (doc_id, source, text), all columns, each as often as the mix takes it whole; rows without words are not taken."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select("doc_id", "source", words().alias("size"), mark().alias("mark"), tie.alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    small = materialize(rows.select("doc_id", "source", "size", "mark"))
    found = taken(rows, small, whole=True, **how).filter("taken > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))
    return found.select("_doc", F.explode(copies)).select("_doc.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(docs.select("doc_id", "source", words().alias("size"), mark().alias("mark")))
    return taken(sized, sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * max(rate) OVER ()) AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
