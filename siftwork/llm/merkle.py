"""A Merkle manifest of a dataset, with an inclusion proof of every document and a check of each proof.

Each row is a leaf, the digest of its fields; the leaves of a language, by id, make a tree of runs of FAN consecutive
nodes, and the languages' roots make the tree at the top. Every level is materialised as a node table: a row a run, with
its tree, level, number and the digests of its nodes. A proof is a lookup: from a leaf's place in its tree, and the number
of leaves, the coordinates (tree, level, run) of all siblings follow by division; they are exploded, joined with the node
table, ordered from the leaf to the root, concatenated and folded. The leaves of one run share every coordinate above
their run, so they explode them together, once.

Leaves are numbered by ranges, so a language may hold any share of the rows. Runs at high levels are needed by many
leaves: those of the levels with few runs (BROADCAST_RUNS in all, counted) are broadcast, the others are shuffled.

Defined results: null fields are `-`; of rows with equal ids, the one with the smaller leaf comes first, and rows equal in
all fields are separate, equal leaves; rows without an id come first in their language and count as tampered with, their
decimal id being empty; an empty text is `0:`; very long texts are digested whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, id_crc, materialize, numbered

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the languages.
TOP = -1
#: Runs of the node table that are broadcast at most (FAN digests of 32 bytes each).
BROADCAST_RUNS = 1 << 13
DIGEST = 32


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest(digests: Column) -> Column:
    """H of digests, as 32 bytes; its input is their hex text, one after the other."""
    return F.unhex(F.sha2(_hex(digests), 256))


def leaf(*fields: Column) -> Column:
    """H of a row's fields, as 32 bytes."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, no_lang, lang, leaf, changed: the leaf of the row as tampered with, null where it is not."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(id_crc() % 3 == 0, leaf(*fields[:-1], ascii_lower(F.col("text"))))
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").isNull().alias("no_lang"), F.coalesce("lang", F.lit("")).alias("lang"), leaf(*fields).alias("leaf"), changed.alias("changed"))


def _joined(members: Column) -> Column:
    """The digests of up to FAN members, in order, as one binary."""
    return F.aggregate(members, F.lit(b""), lambda out, m: F.concat(out, m["leaf"]))


def _before(step: Column) -> Column:
    return F.substring(step["nodes"], F.lit(1), step["position"] * DIGEST)


def _after(step: Column) -> Column:
    return F.substring(step["nodes"], step["position"] * DIGEST + DIGEST + 1, F.length(step["nodes"]))


def _lone() -> Column:
    """Whether a run is a tree's only one, of one node."""
    return (F.col("run") == 0) & (F.length("nodes") == DIGEST)


def levels(bottom: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of runs (tree, level, run, nodes) of a forest, lowest level first, and its roots (tree, root).

    bottom: written runs of leaves (tree, run, nodes), the last of a tree being shorter. A tree of one leaf is no run: its
    leaf is its root.
    """
    single = bottom.filter(_lone()).select("tree", F.col("nodes").alias("root"))
    here = bottom.join(single.select("tree"), "tree", "left_anti").select("tree", F.lit(0).alias("level"), "run", "nodes")
    tables, roots, level = [], single, 0
    while True:
        here = materialize(here)
        if here.isEmpty():
            return tables, materialize(roots)
        tables.append(here)
        level += 1
        above = here.select("tree", F.col("run").alias("at"), digest(F.col("nodes")).alias("leaf"))
        above = above.groupBy("tree", F.expr(f"at div {FAN}").alias("run")).agg(_joined(F.array_sort(F.collect_list(F.struct("at", "leaf")))).alias("nodes"))
        above = materialize(above)
        # a tree whose level has one node is done
        done = above.filter(_lone()).select("tree", F.col("nodes").alias("root"))
        roots = roots.unionByName(done)
        here = above.join(done.select("tree"), "tree", "left_anti").select("tree", F.lit(level).alias("level"), "run", "nodes")


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of leaves (tree, run, nodes, members), the node table above them (tree, level, run, nodes) and roots (tree, root); TOP's root is the dataset's."""
    placed = numbered(materialize(leaves(docs)), ["no_lang", "lang"], ["doc_id", "leaf"])
    langs = placed.groupBy("no_lang", "lang").agg(F.count(F.lit(1)).alias("n"))
    # null first, then by code units of UTF-8; a row a language
    langs = materialize(langs.withColumn("tree", F.row_number().over(Window.orderBy(F.desc("no_lang"), "lang")) - 1))
    runs = placed.groupBy("no_lang", "lang", F.expr(f"place div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "leaf", "doc_id", "changed"))).alias("members"))
    runs = materialize(runs.join(langs.select("no_lang", "lang", "tree"), ["no_lang", "lang"]).select("tree", "run", "members", _joined(F.col("members")).alias("nodes")))
    below, roots = levels(runs.select("tree", "run", "nodes"))
    subroots = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("place"), F.col("root").alias("leaf"))
    tops = subroots.groupBy("tree", F.expr(f"place div {FAN}").cast("long").alias("run")).agg(_joined(F.array_sort(F.collect_list(F.struct("place", "leaf")))).alias("nodes"))
    above, root = levels(materialize(tops))
    table = None
    for part in [*below[1:], *above]:
        table = part if table is None else table.unionByName(part)
    if table is None:
        table = runs.select("tree", F.lit(0).alias("level"), "run", "nodes").limit(0)
    return runs, materialize(table), materialize(roots.unionByName(root))


def _few(table: DataFrame) -> list[int]:
    """The levels, as numbers that _level() gives, with the fewest runs, as long as they have BROADCAST_RUNS in all; a row a level is collected."""
    counts = table.groupBy(_level("tree").alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "l").collect()
    out, total = [], 0
    for r in counts:
        total += r["n"]
        if total <= BROADCAST_RUNS:
            out.append(r["l"])
    return out


def _level(tree: str) -> Column:
    return F.col("level") * 2 + (F.col(tree) == TOP).cast("int")


def _coordinates() -> Column:
    """Of a run of leaves: rank (1 above the languages), of (tree), level, number (of the run there) and position (of the node in it), from the leaves up."""
    div = lambda of, k: F.call_function("div", F.col(of).cast("long"), F.pow(F.lit(FAN), k).cast("long"))

    def above(of: str, first: int, until: Column, tree: Column, rank: int) -> Column:
        level = F.when(until > first, F.sequence(F.lit(first), until - 1)).otherwise(F.array().cast("array<int>"))
        names = lambda *xs: F.struct(*(x.alias(n) for x, n in zip(xs, ("rank", "of", "level", "number", "position"))))
        return F.transform(level, lambda k: names(F.lit(rank), tree, k, div(of, k - first + 1), (div(of, k - first) % FAN).cast("int")))

    return F.concat(above("run", 1, F.col("height"), F.col("tree"), 0), above("tree", 0, F.col("top"), F.lit(TOP), 1))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (array of before and after, from the leaf up), start (the leaf as tampered with); digests are hex text."""
    runs, table, roots = manifest(docs)
    heights = table.groupBy("tree").agg((F.max("level") + 1).alias("height"))
    top = heights.filter(F.col("tree") == TOP).agg(F.coalesce(F.max("height"), F.lit(0)).alias("top"))
    root = roots.filter(F.col("tree") == TOP).select("root")
    langs = roots.filter(F.col("tree") != TOP).join(heights, "tree", "left").select("tree", F.coalesce("height", F.lit(1)).alias("height"), F.col("root").alias("subroot"))
    langs = materialize(langs.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(root)))  # two tables of one row
    runs = runs.join(langs, "tree")
    wanted = runs.select("tree", "run", F.inline(_coordinates()))
    nodes = table.select(F.col("tree").alias("of"), "level", F.col("run").alias("number"), "nodes")
    few = _few(table)
    on = ["of", "level", "number"]
    broad = wanted.filter(_level("of").isin(few)).join(F.broadcast(nodes.filter(_level("of").isin(few))), on)
    dealt = wanted.filter(~_level("of").isin(few)).join(nodes.filter(~_level("of").isin(few)), on)
    found = broad.unionByName(dealt).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "level", "position", "nodes"))).alias("found"))  # a row a level
    rows = runs.join(found, ["tree", "run"], "left")
    kind = "array<struct<position:int,nodes:binary>>"
    higher = F.coalesce(F.transform("found", lambda f: F.struct(f["position"].alias("position"), f["nodes"].alias("nodes"))), F.array().cast(kind))
    rows = rows.select("subroot", "root", "nodes", higher.alias("higher"), _lone().alias("lone"), F.posexplode("members").alias("position", "member"))
    own = F.when(F.col("lone"), F.array().cast(kind)).otherwise(F.array(F.struct("position", "nodes")))
    beside = F.transform(F.concat(own, "higher"), lambda s: F.struct(_hex(_before(s)).alias("before"), _hex(_after(s)).alias("after")))
    start = F.coalesce("member.changed", "member.leaf")
    return rows.select(F.col("member.doc_id").alias("doc_id"), *(_hex(F.col(c)).alias(n) for c, n in (("member.leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))), beside.alias("siblings"), _hex(start).alias("start"))


def verified(proofs: DataFrame) -> DataFrame:
    """proofs with proof_sha256, folded_root and verified."""
    said = F.sha2(F.array_join(F.transform("siblings", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("siblings", F.col("start"), lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))
    return proofs.withColumn("proof_sha256", said).withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    rows = verified(proofs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The CRC is taken bit by bit, as DuckDB has none; the table holds all nodes, and each leaf's way up is a recursion.
ORACLE_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, text, [coalesce(strlen(x) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]] AS head FROM documents),
b AS (SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF ch <> ''])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM b),
n AS (SELECT tree::BIGINT AS tree, 0 AS level, i::BIGINT AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM l
  UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), ceil(any_value(size) / 8.0)::BIGINT FROM n WHERE size > 1 GROUP BY tree, level, i // 8),
s AS (SELECT tree, h FROM n WHERE size = 1),
m AS (SELECT 0 AS level, tree AS i, h, count(*) OVER () AS size FROM s
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), ceil(any_value(size) / 8.0)::BIGINT FROM m WHERE size > 1 GROUP BY level, i // 8),
a AS (SELECT tree, level, i, h, 0 AS rank FROM n WHERE size > 1 UNION ALL SELECT -1, level, i, h, 1 FROM m WHERE size > 1),
r AS (SELECT tree, rank, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM a GROUP BY tree, rank, level, i // 8),
c AS (SELECT l.tree, l.i, r.rank, r.level, r.hs, (CASE WHEN r.rank = 0 THEN l.i ELSE l.tree END) // (8 ** r.level)::BIGINT % 8 AS pos FROM l JOIN r
  ON r.tree = (CASE WHEN r.rank = 0 THEN l.tree ELSE -1 END) AND r.run = (CASE WHEN r.rank = 0 THEN l.i ELSE l.tree END) // (8 ** (r.level + 1))::BIGINT),
p AS (SELECT tree, i, list([array_to_string(hs[1:CAST(pos AS INT)], ''), array_to_string(hs[CAST(pos AS INT) + 2:], '')] ORDER BY rank, level) AS sib FROM c GROUP BY tree, i),
q AS (SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM m WHERE size = 1) AS root, coalesce(p.sib, []) AS sib, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS start
  FROM l JOIN s USING (tree) LEFT JOIN p ON p.tree = l.tree AND p.i = l.i),
g AS (SELECT *, sha256(array_to_string(list_transform(sib, lambda x: x[1] || x[2]), '')) AS proof_sha256, list_reduce(list_concat([[start, '']], sib), lambda d, x: [sha256(x[1] || d[1] || x[2]), ''])[1] AS folded_root FROM q)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
