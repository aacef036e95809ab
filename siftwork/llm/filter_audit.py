"""Audits how filters interact: what each removes, in every order in which they can be applied.

The orders form a trie: an edge applies one more filter to what is left. Walked depth first, each node is a persisted
table of the survivors; nodes of the same filters in another order hold the same rows, so such a state is entered once,
and its edges are counted once (32 states and 80 edges for 120 orders of five filters). A state's edges are counted over
its survivors in one pass; its survivors are released when the walk leaves it, so at most one table a level is persisted.
The persisted rows are narrow: the part, what each filter says of the text (judged once, as a text's verdict does not
depend on the order) and two labels. Only counts leave a state, a row a part, and they stay in tables.

Defined results: a null text counts as empty: under 200 words, and no other failure but repetition; very long texts are
judged whole; a null source and an empty one are one part; of rows with one text those with a larger id than the smallest
fail E, rows that share the smallest id do not, and neither do rows without an id; a row whose id has several labels
counts as quality 1 or toxic 1 if any says so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_join, materialize, text_of

FILTERS = "ABCDE"
#: Fixed values of the filters: words, percent of distinct words, percent of capitals, symbols.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def verdicts(text: Column) -> dict[str, Column]:
    """Whether a text fails, by filter; E needs the whole table and is not here."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: part, A to E (it fails), good, toxic."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text_of().alias("_text"))
    rows = rows.select("doc_id", "part", F.sha2("_text", 256).alias("_sha"), *(v.alias(f) for f, v in verdicts(F.col("_text")).items()))
    rows = materialize(rows)
    # copies: few texts have any, and those with the most are broadcast
    copies = materialize(rows.groupBy("_sha").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = copies.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = hot_join(rows, copies, "_sha", "_n", total, "left")
    rows = rows.withColumn("E", F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = [F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("good", "toxic")]
    keep = ["part", *FILTERS]
    with_id = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").select(*keep, *flags)
    without = rows.filter("doc_id IS NULL").select(*keep, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return with_id.unionByName(without)


def edges(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, state (filters applied before, in alphabetical order), filter, left (before it), removed, good_lost, toxic_lost.

    rows: a written table. Parts without survivors in a state have no rows of it.
    """
    entered: set[frozenset[str]] = set()
    found: list[DataFrame] = []

    def visit(applied: frozenset[str], survivors: DataFrame) -> None:
        entered.add(applied)
        rest = [f for f in filters if f not in applied]
        if not rest:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        told = [F.struct(F.lit(f).alias("filter"), count(F.col(f)).alias("removed"), count(F.col(f) & F.col("good")).alias("good_lost"), count(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in rest]
        counts = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("left"), F.array(*told).alias("_told"))
        found.append(materialize(counts.select("part", F.lit("".join(sorted(applied))).alias("state"), "left", F.inline("_told"))))
        for f in rest:
            if applied | {f} not in entered:
                visit(applied | {f}, survivors.filter(~F.col(f)).drop(f))
        survivors.unpersist()

    visit(frozenset(), rows)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, filter, state (the filters before it, in alphabetical order): a row a step of each order."""
    rows = [("".join(o), k + 1, o[k], "".join(sorted(o[:k]))) for o in itertools.permutations(filters) for k in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state string")


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; zeros included."""
    spark = docs.sparkSession
    counted = materialize(edges(materialize(judged(docs, labels)), filters))
    n = len(filters)
    # orders that pass an edge: those of the filters before it, and those of the filters after it
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n))), F.length("state") + 1)
    last = F.length("state") == n - 1
    by_filter = counted.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.when(last, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley")
    )
    steps = by_filter.join(F.broadcast(orders(spark, filters)), "filter").join(counted, ["part", "state", "filter"], "left")  # n! * n rows are broadcast
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return steps.select(
        "part", "filter_order", "step", (zero("left") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).cast("long").alias("redundant"),
        F.col("unique_fails").cast("long").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(read("documents"), read("labels"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t) AS c,
  regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e, coalesce(good = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM w JOIN m ON w.t = m.t LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS ord FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
st AS (SELECT ord, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, x.i AS step, ord[x.i] AS fi, ord[1:x.i - 1] AS before FROM o, x),
z AS (SELECT part, filter_order, step, fi, fails[fi] AS bad, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS k, good, toxic, n FROM g, st),
r AS (SELECT part, filter_order, step, fi, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0)::BIGINT AS toxic_lost
  FROM z GROUP BY part, filter_order, step, fi)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, fi))::BIGINT AS shapley FROM r
"""
