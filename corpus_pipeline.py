"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of docs; the last adds shard and slot.

Defined results, in every stage: rows are carried whole, so columns of any name stay as they are (shard and slot are
replaced by the last stage); null texts count as empty; null and repeated ids are told apart by their texts; very long
texts are read whole; an empty table stays empty. Ties: of near duplicates with one id, the least hash of the text stays,
and of those with one text, too, the least of their other columns as JSON, whatever the layout of the input; what the
other stages do with ties is said in their modules. A null or empty text scores the share of good labels, is in
no group of near duplicates, holds no benchmark item, and is not taken by the mix, as it has no words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import decontam, jaccard_join, mixing, quality, sharding
from siftwork.llm.common import by_bucket, forget, id_crc, materialize, scratch, text_of

#: Near duplicates: five-word shingles, similarity 0.8 or more.
WIDTH, SIMILAR, OF = 5, 8, 10
SHARDS = 8


def good_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; labels of rows outside the held-out fifth are learned."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_crc() % 5 != 0)
    return quality.scored(docs, model).filter(F.col("score") >= quality.CUT).select("doc.*")


def one_of_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of the least doc_id, then of the least hash of its text; texts without words are in no group and stay."""
    groups = materialize(jaccard_join.jaccard_groups(docs, WIDTH, SIMILAR, OF))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("m")
    least = groups.filter("group IS NOT NULL").groupBy("group").agg(first).select("group", F.xxhash64("m.doc_id").alias("id_tag"), "m.tag", F.lit(True).alias("least"))
    rows = groups.groupBy("doc_id", "tag", "group").agg(F.count(F.lit(1)).alias("n")).withColumn("id_tag", F.xxhash64("doc_id"))
    rows = rows.join(least, ["group", "id_tag", "tag"], "left").withColumn("stays", F.col("group").isNull() | F.col("least").isNotNull())
    # rows to decide on: those that go, and repeated ones, of which one stays; all others stay as they are
    open_ = materialize(rows.filter("n > 1 OR NOT stays").select("id_tag", "tag", "stays"))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    tagged = docs.select(doc, F.xxhash64(F.col("doc_id").cast("long")).alias("id_tag"), F.xxhash64(text_of()).alias("tag"))
    far = by_bucket(tagged, F.col("tag"), open_, F.col("tag"), "left_anti").select("doc.*")
    near = by_bucket(tagged, F.col("tag"), open_, F.col("tag")).join(open_, ["id_tag", "tag"], "left")
    others = [F.col(f"doc.`{c}`") for c in docs.columns if c != "text"]
    once = near.filter("stays").groupBy("id_tag", "tag").agg(F.min_by("doc", F.to_json(F.struct(*others))).alias("doc"))
    return far.unionByName(near.filter("stays IS NULL").select("doc.*")).unionByName(once.select("doc.*"))


def no_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_target_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: whole epochs, and those within the last epoch's budget once more."""
    return mixing.mixed(docs)


def sharded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, equal texts in one shard."""
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources to target weights", to_target_weights),
    ("sharding", sharded),
]

#: Learned weights decide the first stage, so SQL cannot give the rows; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes for itself is deleted when its result is written, and so is the result when the next one is."""
    docs, name = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        before, name = name, f"stage-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), kept_as=name)
        if before:
            forget(spark, before)
    return docs
