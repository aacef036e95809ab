"""Exact deduplication against an immutable snapshot screened by static binary-fuse filters.

Rows are compared by their text after each run of ASCII white space became one space. A snapshot keeps, for each
digest bucket, a binary-fuse filter over the distinct digests. Digests of an incoming batch are screened by it:
those that the filter excludes are new and are grouped among themselves; the others join the exact bucket, and the
texts of the two representatives are compared byte by byte before the groups are merged.

Defined results: a null text counts as empty; a null doc_id sorts first and is kept as such; a row repeated with the
same doc_id and text stays once and its further copies are dropped; very long texts are hashed and compared whole; empty
tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_bucket, hot_join, id_crc, materialize, small_batches, text_of

#: Distinct digests in a bucket, on average; bounds the memory of a filter's construction.
BUCKET_DIGESTS = 100_000
#: Equal rows that are written out at once.
COPIES = 100_000
FILTER_SCHEMA = "bucket long, seed long, segment long, span long, fingerprints binary"


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_of(col), SPACE, " ")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, span: int) -> np.ndarray:
    """The three slots of each hash, in three successive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """A 3-wise binary-fuse filter of 16-bit fingerprints over distinct 64-bit keys: seed, segment, span, fingerprints."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = min(1 << 18, 1 << max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    slots = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    span = max(1, math.ceil(slots / segment) - 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = _slots(h, segment, span)
        size = span + 2 * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        ids = np.arange(len(keys))
        for row in at:
            np.bitwise_xor.at(owner, row, ids)
        rounds, peeled = [], 0
        alone = np.flatnonzero(count == 1)
        while len(alone):
            own, first = np.unique(owner[alone], return_index=True)
            alone = alone[first]
            rounds.append((own, alone))
            peeled += len(own)
            gone = at[:, own]
            np.subtract.at(count, gone.ravel(), 1)
            for row in gone:
                np.bitwise_xor.at(owner, row, own)
            touched = np.unique(gone)
            alone = touched[count[touched] == 1]
        if peeled == len(keys):
            prints, table = _prints(h), np.zeros(size, np.uint16)
            for own, alone in reversed(rounds):
                table[alone] = 0
                table[alone] = prints[own] ^ table[at[0, own]] ^ table[at[1, own]] ^ table[at[2, own]]
            return seed, segment, span, table
    raise RuntimeError("no seed gives a filter")


def in_filter(keys: np.ndarray, seed: int, segment: int, span: int, table: np.ndarray) -> np.ndarray:
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    at = _slots(h, segment, span)
    return _prints(h) == table[at[0]] ^ table[at[1]] ^ table[at[2]]


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, span, table = build_filter(pdf["word"].to_numpy().view(np.uint64))
    return pd.DataFrame([(pdf["bucket"].iloc[0], seed, segment, span, table.tobytes())], columns=["bucket", "seed", "segment", "span", "fingerprints"])


def _screened(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    maybe = np.zeros(len(pdf), bool)
    if len(pdf) and len(filters):
        f = filters.iloc[0]
        maybe = in_filter(pdf["word"].to_numpy().view(np.uint64), int(f.seed), int(f.segment), int(f.span), np.frombuffer(f.fingerprints, np.uint16))
    return pd.DataFrame({"digest": pdf["digest"], "maybe": maybe})


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    """word: 64 bits of the digest; a bucket is picked by other bits."""
    return groups.select("digest", F.xxhash64("digest").alias("word"), F.pmod(F.hash("digest"), F.lit(buckets)).cast("long").alias("bucket"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket over the distinct digests of groups."""
    return _bucketed(groups, buckets).select("bucket", "word").groupBy("bucket").applyInPandas(_built, FILTER_SCHEMA)


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """digest, maybe: whether the snapshot may hold the digest."""
    rows = _bucketed(groups, buckets).groupBy("bucket")
    return rows.cogroup(filters.groupBy("bucket")).applyInPandas(_screened, "digest binary, maybe boolean")


def exact_groups(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, via (how its group was decided).

    in_snapshot marks the rows of the immutable snapshot; the others are the incoming batch.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    counted = materialize(rows.groupBy("digest", "doc_id", "old").agg(F.count(F.lit(1)).alias("n")))
    by_side = counted.groupBy("digest", "old").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.sum("n").alias("rows"))
    sides = materialize(by_side.withColumn("keep", F.when(F.col("nulls") == 0, F.col("least"))).drop("least", "nulls"))
    total, distinct = sides.agg(F.sum("rows"), F.count(F.lit(1))).first()
    buckets = max(1, -(-distinct // BUCKET_DIGESTS))
    old, new = sides.filter("old").drop("old"), sides.filter("NOT old").drop("old")
    filters = materialize(snapshot_filters(old, buckets))
    met = screen(new, filters, buckets)
    maybe = new.join(met.filter("maybe").select("digest"), "digest")
    both = materialize(maybe.join(old.select("digest", F.col("keep").alias("old_keep"), F.col("rows").alias("old_rows")), "digest"))
    same = _same_bytes(docs, both)
    merged = both.join(same, "digest").select(
        "digest",
        F.when(F.col("keep").isNotNull() & F.col("old_keep").isNotNull(), F.least("keep", "old_keep")).alias("keep"),
        (F.col("rows") + F.col("old_rows")).alias("rows"),
        F.lit("exact bucket").alias("via"),
    )
    merged = materialize(merged)
    apart_old = old.join(merged.select("digest"), "digest", "left_anti").select("digest", "keep", "rows", F.lit("snapshot").alias("via"))
    apart_new = new.join(merged.select("digest"), "digest", "left_anti").select("digest", "keep", "rows", F.lit("new batch").alias("via"))
    # a digest whose bytes differed between the sides would have two rows here; the side tells them apart
    groups = merged.select("*", F.lit(None).cast("boolean").alias("side")).unionByName(apart_old.withColumn("side", F.lit(True))).unionByName(apart_new.withColumn("side", F.lit(False)))
    joined = hot_join(counted, groups, "digest", "rows", total or 0).filter("side IS NULL OR side = old")
    stays = F.col("doc_id").eqNullSafe(F.col("keep"))
    one = joined.groupBy("digest", "doc_id", "via", "keep", "rows").agg(F.sum("n").alias("n"))
    # equal rows are counted, not kept apart; they are written out again in blocks
    blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least(F.col("n"), (F.col("block") + 1) * COPIES))))
    return copies.select("doc_id", F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"), (stays & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "via")


def _same_bytes(docs: DataFrame, both: DataFrame) -> DataFrame:
    """The digests whose two representatives have the same bytes."""
    ids = both.select("digest", F.explode(F.array(F.struct(F.lit(True).alias("old"), F.col("old_keep").alias("doc_id")), F.struct(F.lit(False).alias("old"), F.col("keep").alias("doc_id")))).alias("r")).select("digest", "r.old", "r.doc_id")
    ids = ids.filter("doc_id IS NOT NULL")
    # of the texts, only those whose bucket has a representative are shuffled
    texts = by_bucket(docs.select("doc_id", "text"), F.col("doc_id"), ids, F.col("doc_id")).select("doc_id", normalised().alias("bytes"))
    wanted = ids.hint("merge").join(texts, "doc_id").filter(F.unhex(F.sha2("bytes", 256)) == F.col("digest"))
    wanted = materialize(wanted.dropDuplicates(["digest", "old"]))  # rows of one id may repeat their text
    # rows without an id have no representative to look up: their digest decides
    bare = both.filter("keep IS NULL OR old_keep IS NULL").select("digest")
    left = wanted.filter("old").select("digest", F.col("bytes").alias("a"))
    right = wanted.filter("NOT old").select("digest", F.col("bytes").alias("b"))
    return left.join(right, "digest").filter("a = b").select("digest").unionByName(bare).distinct()


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Half of documents, by crc32 of the id, is the snapshot; the other half arrives as a batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, id_crc() % 2 == 0).drop("via")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
