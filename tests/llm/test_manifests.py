"""Merkle manifests, filter audits and packing against brute force, on rows with nulls, long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import LOWER, docs, none, rows_of  # noqa: F401  fixtures

from siftwork.llm import filter_audit, merkle, packing, token_counts

ITEMS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---


def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_proofs(nodes):
    """Of each node: its siblings before and after, level by level, and the root."""
    ways, level = [[] for _ in nodes], [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for run in (level[i : i + 8] for i in range(0, len(level), 8)):
            for k, (_, below) in enumerate(run):
                for i in below:
                    ways[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
        level = above
    return ways, level[0][0]


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted(((r, plain_leaf(*r)) for r in rows if r[2] == g), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for g in langs]
    ways = [plain_proofs([h for _, h in t]) for t in trees]
    tops, root = plain_proofs([r for _, r in ways])
    out = []
    for tree, (way, subroot), top in zip(trees, ways, tops):
        for (r, h), steps in zip(tree, way):
            d = h
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0:
                d = plain_leaf(*r[:4], None if r[4] is None else r[4].translate(LOWER))
            for a, b in [*steps, *top]:
                d = sha(a + d + b)
            out.append((r[0], h, subroot, root, sha("".join(a + b for a, b in [*steps, *top])), d, d == root))
    return sorted(out, key=str)


def proofs_of(table):
    rows = merkle.verified(merkle.proofs(table)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


def test_manifest_equals_brute_force(docs, none):  # noqa: F811
    table = docs.withColumn("text", F.initcap("text"))
    rows = [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = proofs_of(table)
    assert got == plain_manifest(rows) and len({r[-1] for r in got}) == 2
    assert proofs_of(table.repartition(2, "text")) == got
    assert merkle.verified(merkle.proofs(none)).count() == 0


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 65, 1], [513, 2]])
def test_manifest_of_every_shape(spark, sizes):
    rows = [(100 * k + i, "s", f"l{k}" if k else None, 1, "A" * (i % 3)) for k, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert proofs_of(table) == plain_manifest(rows)


def test_manifest_of_many_languages_and_shuffled_levels(spark, monkeypatch):
    """More than a run of languages, and levels that are not broadcast."""
    rows = [(i, None, f"l{i % 70}é" if i % 5 else "big", i, "Text" if i % 2 else None) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = plain_manifest(rows)
    for most in (0, 3, 1 << 13):
        monkeypatch.setattr(merkle, "BROADCAST_RUNS", most)
        assert proofs_of(table) == want


# --- 12 ---


def plain_audit(rows, labels):
    """rows: doc_id, source, text; labels: doc_id -> (good, toxic)."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = collections.defaultdict(list)
    for i, part, t in rows:
        t = t or ""
        w = ITEMS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged[part or ""].append(({f for f, x in fails.items() if x}, *labels.get(i, (0, 0))))
    out = []
    for part, mine in judged.items():
        shapley = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            here = list(mine)
            for k, f in enumerate(order):
                gone = [x for x in here if f in x[0]]
                here = [x for x in here if f not in x[0]]
                shapley[f] += len(gone)
                fails = sum(f in x[0] for x in mine)
                lines.append((f, "".join(order), k + 1, len(here), len(gone), fails - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, *x[1:], shapley[x[0]]) for x in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark, docs, none):  # noqa: F811
    r = random.Random(3)
    labels = {i: (r.randint(0, 1), r.randint(0, 1)) for i in range(0, 330, 2)}
    given = [(i, *x) for i, x in labels.items()] + [(0, 0, None), (2, None, None), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    extra = [(800 + i, " ".join(r.choice(["Ab", "cd#", "ef", "GH"]) + str(r.randint(0, n)) for _ in range(250)), "en", ["", "s1", None][i % 3]) for i, n in enumerate([0, 5, 40, 90, 200, 900] * 4)]
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra + extra[:6], "doc_id long, text string, lang string, source string"))
    want = plain_audit([tuple(x) for x in rows.select("doc_id", "source", "text").collect()], labels)
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = sorted(tuple(x) for x in filter_audit.audit(rows, table).select(*names).collect())
    assert got == want and any(x[5] for x in got) and any(x[6] for x in got) and any(x[7] for x in got)
    assert filter_audit.audit(none, table).count() == 0


def test_each_state_is_entered_once(spark, monkeypatch):
    """32 states, of which 31 have edges, and 80 edges."""
    written = []
    keep = filter_audit.materialize
    monkeypatch.setattr(filter_audit, "materialize", lambda df: written.append(1) or keep(df))
    rows = keep(spark.createDataFrame([("p", True, False, False, False, False, True, False)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean"))
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    found = filter_audit.edges(rows).collect()
    assert len(written) == 31 and len({r["state"] for r in found}) == 16  # the others hold no row
    assert {(r["state"], r["filter"]) for r in found} == {("".join(s), f) for n in range(5) for s in itertools.combinations("BCDE", n) for f in set("ABCDE") - set(s)}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == held


# --- 13 ---


def plain_ids(text, by):
    return [*by.library.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(got, texts):
    """texts: doc_id -> list of texts. Each id is in one piece, sequences are gapless and not too long; gives the padding."""
    by = packing.encoder(token_counts.vocabulary())
    want = collections.Counter()
    for i, ts in texts.items():
        for t in ts:
            ids = plain_ids(t, by)
            want[i] += len(ids)
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        fit = [ids for ids in (plain_ids(t, by) for t in texts[r["doc_id"]]) if len(ids) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in fit}
        want[r["doc_id"]] -= r["length"]
    assert not +want and not -want
    for i, ts in texts.items():
        if len(ts) == 1:
            mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
            assert [a for a, _ in mine] == [0, *itertools.accumulate(n for _, n in mine)][:-1]
    sizes = []
    for s in spans.values():
        assert [a for a, _ in sorted(s)] == [0, *itertools.accumulate(n for _, n in sorted(s))][:-1]
        sizes.append(sum(n for _, n in s))
    assert not sizes or max(sizes) <= 2048
    return sum(2048 - n for n in sizes if n.bit_count() != 1)


def test_packing_equals_brute_force(docs, none):  # noqa: F811
    texts = collections.defaultdict(list)
    for i, t, *_ in rows_of():
        texts[i].append(t)
    got = packing.packed(docs).collect()
    total = sum(r["length"] for r in got)
    assert check_packing(got, texts) < 2048 + 0.01 * total
    assert packing.packed(none).count() == 0 and packing.sequences(none).count() == 0


def test_packing_cuts_pieces_where_lengths_do_not_fit(spark):
    """All documents but one of 1,401 tokens: no two share a window whole."""
    rows = [(i, "a " * 1399 + "b" * (i % 2)) for i in range(40)] + [(40, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.packed(table).collect()
    assert check_packing(got, {i: [t] for i, t in rows}) < 2048
    assert any(r["start"] for r in got)


def test_sequences_hold_the_ids(spark, docs):  # noqa: F811
    by = packing.encoder(token_counts.vocabulary())
    some = docs.filter("doc_id < 330 OR doc_id = 407").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in packing.sequences(some, pad=7).collect():
        used = 0
        for d in r["documents"]:
            assert d["offset"] == used
            assert r["ids"][used : used + d["length"]] == plain_ids(texts[d["doc_id"]], by)[d["start"] : d["start"] + d["length"]]
            used += d["length"]
        assert used.bit_count() == 1 and len(r["ids"]) == used or len(r["ids"]) == 2048 and set(r["ids"][used:]) <= {7}


def test_fill_is_closest():
    r = random.Random(5)
    for _ in range(300):
        window = r.randint(5, 40)
        counts = {x: r.randint(1, 4) for x in r.sample(range(1, window + 1), r.randint(1, 5))}
        got = packing.fill(counts, sorted(counts), window)
        sums = {sum(x * n for x, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values())) if dict(zip(counts, ns))[max(counts)]}
        assert all(0 < n <= counts[x] for x, n in got.items()) and got[max(counts)] and sum(x * n for x, n in got.items()) == max(s for s in sums if s <= window)


@pytest.mark.parametrize("counts", [{1500: 10_000}, {700: 90_000} | {x: 40 for x in range(1, 2049, 3)}, {2048: 5}, {1: 3}, {x: 1_000_000 for x in range(1, 2048)}])
def test_plan_places_every_token_once(counts):
    plan = packing.Plan(counts)
    total = sum(x * n for x, n in counts.items())
    assert sum((high - low) * n for _, low, _, n, high, *_ in plan.rows) == total
    assert plan.sequences * 2048 - total < 2048 + 0.004 * total and len(plan.rows) < 60_000
    by = collections.defaultdict(list)
    for length, low, first, n, high, *_ in plan.rows:
        by[length].append((first, n, low, high))
    for length, rows in by.items():  # of some pieces: their parts follow each other
        for number in {first for first, *_ in rows}:
            parts = sorted((low, high) for first, n, low, high in rows if first <= number < first + n)
            assert parts[0][0] == 0 and parts[-1][1] == length and all(a[1] == b[0] for a, b in itertools.pairwise(parts))
    assert math.isfinite(total)


def test_numbers_follow_the_order_in_each_group(spark):
    from siftwork.llm.common import materialize, numbered

    table = materialize(spark.range(5000).select((F.col("id") % 3 % 2).alias("g"), F.xxhash64("id").alias("x")))
    rows = numbered(table, ["g"], ["x"]).collect()
    for g in (0, 1):
        mine = sorted((r["x"], r["place"]) for r in rows if r["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine)))
