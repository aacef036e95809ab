"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group, and a group stays whole. The differencing method keeps partial partitions (a tuple of sums,
one a shard) on a heap by their spread and repeatedly combines the two of largest spread, oppositely ordered. A
corpus has more groups than one process holds, so groups are hashed into buckets of bounded size; each bucket is
differenced into PARTS parts, the parts are the next level's indivisible groups, and so on until at most TOP of them
are left, which the driver differences into the shards: the base of the recursion. A level divides the count by
BUCKET / PARTS; a corpus of up to TOP groups is differenced at once.

Defined results: a null text counts as empty (size 1); ties in size go by the text's digest; a very long text weighs what
it has; rows with equal texts, repeated rows and null ids included, go
to one shard; an empty table gives an empty result; other columns are ignored here and kept by shard_rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialize, small_batches, text_of

BUCKET, PARTS, TOP = 4096, 16, 8192
#: Rows that are numbered together.
SLOT_ROWS = 20_000


def difference(sizes: list[int], parts: int) -> np.ndarray:
    """The part of each item, by the largest differencing method."""
    if not sizes:
        return np.zeros(0, np.int64)
    # a partial partition: its sums in descending order, and for each of them the tree of items in it
    heap = [(-int(s), i, [int(s)] + [0] * (parts - 1), [i] + [None] * (parts - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        trees = [y if x is None else x if y is None else (x, y) for x, y in zip(left, reversed(right))]
        by_sum = sorted(range(parts), key=sums.__getitem__, reverse=True)
        low = sums[by_sum[-1]]
        order += 1
        heapq.heappush(heap, (low - sums[by_sum[0]], order, [sums[k] - low for k in by_sum], [trees[k] for k in by_sum]))
    out = np.zeros(len(sizes), np.int64)
    for part, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                out[x] = part
    return out


def _parted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["total", "item"], ascending=[False, True], kind="stable")
    part = difference(pdf["total"].tolist(), PARTS)
    return pd.DataFrame({"item": pdf["item"].to_numpy(), "total": pdf["total"].to_numpy(), "above": pdf["bucket"].to_numpy() * PARTS + part})


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """item, shard for groups of (item: any unique sortable key, total: long)."""
    spark, levels, level = groups.sparkSession, [], groups
    kind = groups.schema["item"].dataType.simpleString()
    while (n := level.count()) > TOP:
        buckets = -(-n // BUCKET)
        dealt = level.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        parted = materialize(dealt.groupBy("bucket").applyInPandas(_parted, f"item {kind}, total long, above long"))
        levels.append(parted.select("item", "above"))
        level, kind = materialize(parted.groupBy(F.col("above").alias("item")).agg(F.sum("total").alias("total"))), "long"
    top = sorted(((r["total"], r["item"]) for r in level.select("item", "total").collect()), key=lambda r: (-r[0], r[1]))  # TOP rows at most
    part = difference([t for t, _ in top], shards)
    out = spark.createDataFrame([(i, int(p)) for (_, i), p in zip(top, part)], f"item {kind}, shard int")
    for below in reversed(levels):
        out = below.join(F.broadcast(out) if below is levels[-1] else out.select(F.col("item"), "shard"), below["above"] == out["item"]).select(below["item"], "shard")
    return out


def shard_rows(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard) of the rows of docs (doc_id, text), and doc, if docs has such a column."""
    small_batches(docs.sparkSession)
    text = text_of()
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("item"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(["doc"] if "doc" in docs.columns else []))
    small = materialize(rows.drop("doc"))
    groups = materialize(small.groupBy("item").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    dealt = materialize(assign(groups.select("item", "total"), shards)).join(groups.select("item", "n"), "item")
    return numbered(hot_join(rows if "doc" in docs.columns else small, dealt, "item", "n", total).drop("n", "item"), total)


def with_shards(docs: DataFrame, shards: int) -> DataFrame:
    """The rows of docs, all columns but former ones of these names, with shard and slot."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return shard_rows(docs.select("doc_id", "text", F.struct(*columns).alias("doc")), shards).select("doc.*", "shard", "slot")


def numbered(rows: DataFrame, total: int, by: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Adds slot: gapless from 0 in each shard. Rows are numbered in bounded buckets, which start where the ones before end."""
    buckets = max(1, -(-total // SLOT_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*by)) - 1
    return rows.withColumn("_place", place).join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_start")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
