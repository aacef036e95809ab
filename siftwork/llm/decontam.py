"""Benchmark items inside long documents: size-partitioned MinHash containment search, verified by exact shingles.

Words are maximal runs of letters and digits, lower-cased; a shingle is WIDTH successive words. An item is inside a
document if the document has at least THRESHOLD of the item's distinct shingles. Items are partitioned by size, in
bands of a factor of two. The sketch of an item is the k least of its shingles' hashes (a bottom-k MinHash), with
k = floor((1 - THRESHOLD) * largest size in the band) + 1: a document that has THRESHOLD of the shingles misses fewer
than k of them, so it has at least one in the sketch, and none is lost. Documents shorter than THRESHOLD of the
item's size cannot hold it and are passed over. Candidates are verified over the texts themselves: the shares are
exact counts of shingle strings, not of hashes. Only DataFrame functions are used.

Of a document's hashes, those are left out before the search that are above the highest sketched one of all bands whose
items the document is long enough to hold, or whose bit is in no sketch (BITS_EACH bits a sketched hash, MOST_BITS at
most; beyond it the bits let more hashes through). Sketches are broadcast in slices of items, of about BROADCAST_ROWS
rows each; with more than one slice the hashes that are left are written once and every slice reads them. Texts are verified only where a document's bucket has a candidate, so few texts are shuffled.

Defined results: null texts and texts without words hold nothing, and items without words are in no document; an item
of fewer than WIDTH words is one shingle of all its words, which a document has only if these are all its words;
repeated rows of a document give one row for each item; very long texts are searched whole; of equally sized sets the
sketch is the same, as ties in hashes are one element; rows whose id is null count as one document without an id;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, materialize, text_of

WIDTH, THRESHOLD = 5, 0.8
BROADCAST_ROWS = 1_000_000
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 18
WORD = r"[\p{L}\p{N}]+"


def _words(col: str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit(WORD), F.lit(0))


def _shingles(words: Column, width: int, of) -> Column:
    """of(list of columns or the whole array) at each start; the whole sequence if there are fewer words; none without words."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    return (
        F.when(F.size(words) >= width, F.transform(starts, lambda i: of([F.get(words, i + k) for k in range(width)])))
        .when(F.size(words) > 0, F.array(of([F.concat_ws(" ", words)])))
        .otherwise(F.array().cast("array<string>") if of is _string else F.array().cast("array<bigint>"))
    )


def _string(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def item_sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, h, least: the sketch's hashes of each item, and the least number of shingles of a document that can hold it."""
    sets = items.select("item_id", _words("text").alias("_w")).select("item_id", F.array_distinct(_shingles(F.col("_w"), width, _hash)).alias("_h")).filter(F.size("_h") > 0)
    q = F.size("_h")
    band_top = F.pow(2, F.floor(F.log2(q)) + 1) - 1
    k = F.least(q, (F.floor(band_top * (1 - threshold) + 1e-9) + 1).cast("int"))
    least = F.ceil(q * threshold - 1e-9).cast("int").alias("least")
    return sets.select("item_id", F.explode(F.slice(F.array_sort("_h"), F.lit(1), k)).alias("h"), least)


def _bits(sketches: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A row with an array of words of 64 bits, one bit of which is set for each hash of the sketches; and the number of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (count * BITS_EACH).bit_length()))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    words = sketches.groupBy(F.shiftright(F.pmod("h", F.lit(bits)), 6).alias("id")).agg(F.bit_or(one).alias("b"))
    every = sketches.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("_b")).select(F.col("_b.b").alias("_bits")), bits


def candidates(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct doc_id, item_id of documents that have a shingle of the item's sketch."""
    sketches = materialize(item_sketches(items, width, threshold))
    # a row a power of two that sizes have
    bands = sketches.groupBy(F.floor(F.log2("least")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("h").alias("highest")).collect()
    count = sum(b["n"] for b in bands)
    size = F.greatest(F.size("_w") - (width - 1), F.lit(1))
    bound = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(size >= b["least"], F.lit(b["highest"])) for b in bands))
    table, bits = _bits(sketches, count)
    # one row of a fixed size
    rows = docs.select("doc_id", _words("text").alias("_w")).withColumn("_bound", bound).filter("_bound IS NOT NULL").crossJoin(F.broadcast(table))
    at = lambda h: F.pmod(h, F.lit(bits))
    known = lambda h: F.call_function("shiftright", F.get("_bits", F.shiftright(at(h), 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    hashes = F.filter(_shingles(F.col("_w"), width, _hash), lambda h: (h <= F.col("_bound")) & known(h))
    rows = rows.select("doc_id", size.alias("_n"), F.explode(hashes).alias("h"))
    slices = max(1, -(-count // BROADCAST_ROWS))
    if slices > 1:
        rows = materialize(rows)
    met = [rows.join(F.broadcast(sketches.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i)), "h") for i in range(slices)]
    return reduce(DataFrame.unionByName, met).filter("_n >= least").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for the items that documents hold."""
    found = materialize(candidates(docs, items, width, threshold))
    whole = items.select("item_id", F.array_distinct(_shingles(_words("text"), width, _string)).alias("_item"))
    pairs = found.join(whole, "item_id").select(F.col("doc_id").alias("_id"), "item_id", "_item")
    texts = by_bucket(docs.select("doc_id", "text"), F.col("doc_id"), found, F.col("doc_id")).hint("merge")
    met = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "item_id", "_item", _words("text").alias("_w"))
    shared = F.size(F.array_intersect("_item", _shingles(F.col("_w"), width, _string)))
    met = met.select("doc_id", "item_id", F.size("_item").cast("long").alias("item_shingles"), shared.cast("long").alias("shared"))
    best = met.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("shared").alias("shared"))
    return best.filter(F.col("shared") >= F.ceil(F.col("item_shingles") * threshold - 1e-9)).withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Rows are told apart by id and text, as ids may be null or repeated."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("tag")).alias("doc_id"), "text", doc)
    bad = contained(rows.select("doc_id", "text"), items, **how).select(F.xxhash64("doc_id.id").alias("id_tag"), F.col("doc_id.id").alias("id"), F.col("doc_id.tag").alias("tag")).distinct()
    bad = materialize(bad)
    same = (F.xxhash64("doc_id.id") == F.col("id_tag")) & F.col("doc_id.id").eqNullSafe(F.col("id")) & (F.col("doc_id.tag") == F.col("tag"))
    far = by_bucket(rows, F.col("doc_id.tag"), bad, F.col("tag"), "left_anti").select("doc.*")
    return far.unionByName(by_bucket(rows, F.col("doc_id.tag"), bad, F.col("tag")).join(bad, same, "left_anti").select("doc.*"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All items of benchmark against all documents."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
q AS (SELECT item_id, count(*)::BIGINT AS item_shingles FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, round(shared / item_shingles, 6) AS containment FROM m JOIN q USING (item_id) WHERE 10 * shared >= 8 * item_shingles
"""
