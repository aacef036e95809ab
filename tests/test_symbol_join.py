"""The similarity join against all pairs, and searches by posted trigrams against scans."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions.scalars import similarity
from siftwork.operators import search, symbol_join


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(2)
    parts = ["get", "set", "User", "name", "HTTP", "server", "parse", "_", "-", "x", "id", "Ü", "tok", "en"]
    out = {"".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(300)}
    out |= {"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 14))) for _ in range(250)}
    out |= {"a", "b", "ab", "ba", "aa", "abc", "_", "__", "A_b", "aaaa", "aaaab", "a" * 70, "ab" * 45, "ab" * 30, "abc" * 20, "z" * 33 + "ab" * 16, "100%", "a\\b", "per%cent", "under_score"}
    return spark.createDataFrame([(n, f"f{i % 9}", i) for i, n in enumerate(sorted(out))] + [(None, "f", 1), ("", "f", 2), ("ab", "f0", 3)], "name string, file_path string, line int")


@pytest.fixture(scope="module")
def queries(spark, names):
    known = [r["name"] for r in names.dropna().filter("name <> ''").orderBy(F.xxhash64("name")).limit(90).collect()]
    typos = [n[:i] + n[i + 1 :] for n in known if len(n) > 3 for i in (len(n) // 2,)]
    return spark.createDataFrame([(q,) for q in [*known[:40], *typos, "a", "ab", "zz", "a" * 66, "ab" * 40, "z" * 30, "GETUSERNAME", "", None]], "name string")


@pytest.mark.parametrize("least", [0.4, 0.5])
def test_join_equals_all_pairs(spark, names, queries, least):
    q, n = queries.filter("name <> ''").distinct().withColumnRenamed("name", "query"), names.select("name").filter("name <> ''").distinct()
    every = q.crossJoin(n)
    want = {(r["query"], r["name"], r["score"]) for r in every.withColumn("score", F.round(similarity("query", "name"), 6)).filter(F.col("score") >= least).collect()}
    got = [tuple(r) for r in symbol_join.similar_pairs(queries, names, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert symbol_join.candidates(queries, names, least).count() < {0.4: 0.7, 0.5: 0.5}[least] * every.count()


@pytest.mark.parametrize("least, few", [(0.4, 0), (0.5, 0), (0.666667, 0), (0.666667, symbol_join.FEW)])
def test_joins_by_signatures_and_by_bits_equal_all_pairs(spark, names, queries, least, few):
    # names of separators alone are equal but for these; 2 of 3 characters are 0.666667 when rounded
    more = spark.createDataFrame([(x,) for x in ("-", "_-_", "____", " ", "qbc", "qbd")], "name string")
    queries, names = queries.unionByName(more), names.select("name").unionByName(more)
    q, n = queries.filter("name <> ''").distinct().withColumnRenamed("name", "query"), names.filter("name <> ''").distinct()
    want = {tuple(r) for r in q.crossJoin(n).withColumn("score", F.round(similarity("query", "name"), 6)).filter(F.col("score") >= least).collect()}
    assert {("-", "____", 0.98), ("qbc", "qbd", 0.666667)} <= want
    got = symbol_join.similar_pairs(queries, names, least, few).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_few_queries_are_sent_to_the_names(names, queries):
    plan = symbol_join.similar_pairs(queries, names)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # no signatures are shuffled, and no join takes a measure of all its pairs
    assert len(joins) == 1 and "BroadcastNestedLoopJoin" in joins[0] and "levenshtein" not in joins[0] and "regexp_replace" not in joins[0]


def test_many_queries_equal_one_by_one(names, queries):
    some = [r["name"] for r in queries.filter("length(name) > 3").orderBy("name").limit(2).collect()]
    many = symbol_join.fuzzy_many(names, queries).collect()
    told = symbol_join.suggest_many(names, queries).collect()
    for q in some:
        assert [(r["name"], r["file_path"], r["line"], r["score"]) for r in sorted((r for r in many if r["query"] == q), key=lambda r: r["place"])] == [(r["name"], r["file_path"], r["line"], r["score"]) for r in search.fuzzy(names.filter("name <> ''"), q).collect()]
        assert {(r["file_path"], r["name"], r["score"], r["place"]) for r in told if r["query"] == q} == {(r["file_path"], r["name"], r["score"], r["place"]) for r in search.suggest(names.filter("name <> ''"), q).collect()}


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    symbol_join.write_index(names, path, 16)
    return symbol_join.NameIndex(spark, path, 16)


@pytest.mark.parametrize("needle", ["user", "HTTPserver", "en", "a", "abc", "%", "r_sc", "per%", "a\\b", "ü", "nothing here", "ABAB"])
def test_like_by_trigrams_equals_a_scan(names, index, needle):
    assert index.like(needle, None).collect() == search.like(names, needle, 10**6).collect()
    assert index.search(needle).collect() == search.search(names.filter("name <> ''"), needle).select(index.search(needle).columns).collect()
    assert index.search(needle, True).count() == search.search(names, needle, True).count() or not search.search(names, needle, True).filter("match = 'exact'").count()


def test_a_search_reads_one_bucket_of_trigrams(index):
    rows = index.names("HTTPserver")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) >= 1
    read = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert read.selectedPartitions().partitionCount() == 1
    exact = index.exact("getUser")
    assert exact._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().partitionCount() == 1
