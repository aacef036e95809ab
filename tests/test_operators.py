"""Logs, repository maps, trees, lock files, reads, index and streaming on small fixtures."""

import json
import re
import time

from pyspark.sql import functions as F

from siftwork.operators import index, lockfile, logs, reads, repomap, savings, search, smart_read

LOGS = "log_id long, type_hint string, exit_code int, bypass boolean, raw string"


def pruned(spark, *rows, **how):
    data = [(i, *r) for i, r in enumerate(rows)]
    return [r.asDict() for r in logs.prune(spark.createDataFrame(data, LOGS), **how).orderBy("log_id").collect()]


def test_logs(spark):
    pytest_log = "==== test session starts ====\nrootdir: /x\ncollected 2 items\na.py::t PASSED [ 50%]\nb.py::t FAILED [100%]\n==== 1 failed, 1 passed in 2s ===="
    tb = "x pytest collected\nTraceback (most recent call last):\n  boom"
    got = pruned(
        spark,
        ("auto", 0, False, pytest_log.replace("rootdir", "pytest-9\nrootdir")),
        ("auto", 1, False, tb),
        ("npm", 0, True, "GET x"),
        ("npm", 0, False, "GET x"),
        ("npm", 1, False, "fetch fatal\nok"),
        ("generic", 0, None, "\x1b[31mred\x1b[0m"),
        ("cargo", 0, False, "test a ... ok\ntest result: ok. 1 passed"),
        ("nothing", 0, False, None),
        ("git", 0, False, 'a (use "git add" to x)\n  (use "git rm")\nhint: y'),
    )
    assert got[0]["kind"] == "pytest" and got[0]["filtered"].endswith("pytest: 1 FAILED, 1 passed") and "PASSED" not in got[0]["filtered"]
    assert got[1]["kind"] == "traceback" and got[1]["filtered"] == tb
    assert (got[2]["guard"], got[2]["filtered"]) == ("bypass", "GET x")
    assert (got[3]["guard"], got[3]["filtered"]) == ("empty", "GET x")
    assert (got[4]["guard"], got[4]["filtered"]) == ("error", "fetch fatal\nok")
    assert got[5]["filtered"] == "red"
    assert got[6]["filtered"] == "test result: ok. 1 passed"
    assert got[7]["filtered"] == ""
    assert got[8]["filtered"] == "a"


def test_long_log_keeps_both_ends(spark):
    r = pruned(spark, ("generic", 0, False, "a" * 50 + "b" * 50 + "c" * 50), most=100, head=20, tail=10)[0]
    assert r["filtered"].startswith("a" * 20 + "\n\n... [truncated 120") and r["filtered"].endswith("c" * 10)


def test_inbound_equals_nested_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "file_path")
    words = docs.limit(40).select("file_path", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))).alias("name"), F.lit(0).alias("ord"))
    odd = spark.createDataFrame([(3, "of the", 0), (4, "an,", 0)], "file_path long, name string, ord int")
    named = repomap.definers(words.unionByName(odd)).cache()
    fast = {tuple(r) for r in repomap.inbound(docs, named).collect()}
    assert fast == {tuple(r) for r in repomap.inbound_naive(docs, named).collect()} and fast


def test_budget_at_equality(spark):
    files = spark.createDataFrame([("a", 3.0, 4), ("b", 3.0, 5), ("c", 2.0, 9), ("d", 1.0, 1)], "file_path string, score double, tokens long")
    assert [r["file_path"] for r in repomap.within_budget(files, 10, 1).collect()] == ["a", "b"]
    assert repomap.within_budget(files, 4, 1).count() == 0


def test_tree(spark):
    names = [f"d/f{i:02d}.py" for i in range(20)] + ["B.txt", "a.txt", "d/e/x.py", "d/e/g/h/i/deep.py", ".git/x", "k.pem", "p.png"]
    got = [(r["depth"], r["name"], r["kind"]) for r in repomap.directory_tree(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("place").collect()]
    assert got[:3] == [(0, "d", "folder"), (1, "e", "folder"), (2, "g", "folder")] and (4, "...", "deeper") in got
    assert (1, "+11", "more") in got and [g[1] for g in got[-2:]] == ["a.txt", "B.txt"] and len([g for g in got if g[0] == 1]) == 11


def ask(spark, name, content, query):
    return lockfile.ask(spark.createDataFrame([(name, content, query)], "file_name string, content string, query string")).first()


def test_lockfiles(spark):
    npm = json.dumps({"lockfileVersion": 3, "packages": {"": {"dependencies": {"left-pad": "^1"}}, "node_modules/Left-Pad": {"version": "1.3.0"}, "node_modules/lodash": {"version": "4"}, "node_modules/lodash-es": {"version": "4"}}})
    assert json.loads(ask(spark, "a/package-lock.json", npm, "lodash")["matches"][0]) == {"node_modules/lodash": {"version": "4"}}
    assert len(ask(spark, "package-lock.json", npm, "LODA")["matches"]) == 2
    assert ask(spark, "package-lock.json", npm, "absent")["status"] == "not_found"
    s = ask(spark, "package-lock.json", npm, None)["summary"]
    assert (s["version"], s["packages"], s["direct"], s["sample"]) == ("3", 4, 1, ["left-pad@^1"])
    assert json.loads(ask(spark, "package-lock.json", json.dumps({"dependencies": {"ab": {"version": "1"}}}), "B")["matches"][0]) == {"ab": {"version": "1"}}
    cargo = "\n".join(f'[[package]]\nname = "p{i}"\nversion = "0.{i}"\n' for i in range(5))
    assert len(ask(spark, "Cargo.lock", cargo, "P")["matches"]) == 3
    yarn = '# c\n\n"left@^1":\n  version "1.0"\n\nright@^2:\n  version "2.0"\n'
    assert ask(spark, "yarn.lock", yarn, "right")["matches"] == ['right@^2:\n  version "2.0"']
    composer = json.dumps({"packages": [{"name": "a/b"}], "packages-dev": [{"name": "c/d", "v": 1}]})
    assert json.loads(ask(spark, "composer.lock", composer, "D")["matches"][0]) == {"name": "c/d", "v": 1}
    r = ask(spark, "x.min.js", "q" * 500 + "Needle" + "r" * 500, "needle")
    assert (r["how"], r["context"]["first"], r["context"]["last"]) == ("context", 400, 700)
    assert ask(spark, "package-lock.json", "{broken", "x")["status"] == "not_found"


def test_reads_and_stream(spark, tmp_path):
    rows = [("a", 1, "one\ntwo\n" * 30), ("a", 2, "one\ntwo\n" * 30), ("a", 3, "one\ntwo\n" * 30 + "three\n"), ("b", 4, "x"), ("b", 5, "y"), ("b", 6, None), ("b", 7, None)]
    df = spark.createDataFrame(rows, "key string, read_ord long, content string")
    got = [(r["status"], r["read_no"]) for r in reads.read_results(df).orderBy("read_ord").collect()]
    want = [("FIRST_READ", 1), ("UNCHANGED", 2), ("CHANGED", 3), ("FIRST_READ", 1), ("CHANGED", 2), ("CHANGED", 3), ("UNCHANGED", 4)]
    assert got == want
    third = reads.read_results(df).filter("read_ord = 3").first()
    assert third["text"].endswith("+three\n") and third["opt_tokens"] < third["orig_tokens"]
    assert reads.read_results(df).filter("read_ord = 5").first()["text"] == "y"  # a diff would be longer
    stats = reads.read_stats(reads.statuses(df)).first()
    assert (stats["reads"], stats["first_reads"], stats["hits"], stats["diffs"]) == (7, 2, 2, 3)

    from siftwork.streaming.reads import read_statuses, running_savings

    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = read_statuses(stream).writeStream.format("memory").queryName("reads_t").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["status"], r["read_no"]) for r in spark.table("reads_t").orderBy("read_ord").collect()] == want
    # with expiring state a query never ends by itself, as states may time out later
    run = read_statuses(stream, 3_600_000).writeStream.format("memory").queryName("reads_e").outputMode("append").start()
    for _ in range(60):
        if spark.table("reads_e").count() == len(want):
            break
        time.sleep(0.5)
    run.stop()
    assert spark.table("reads_e").count() == len(want)
    events = spark.createDataFrame([("cache", 1000, 200), ("cache", 10, 20), ("slice", 0, 5)], "category string, original long, optimized long")
    events.write.parquet(str(tmp_path / "s"))
    run = running_savings(spark.readStream.schema(events.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("sav_t").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("sav_t").collect()] == [("cache", 1010, 220, 800, 2)]


def test_savings(spark):
    events = spark.createDataFrame([("cache", 1000, 200), ("other", 100, 50), ("slice", -1, 5)], "category string, original long, optimized long")
    r = savings.totals(events).first()
    assert (r["original"], r["saved"], r["saved_pct"], r["dollars"]) == (1100, 850, 80.0, 0.00255)
    assert savings.totals(events.limit(0)).first()["saved_pct"] == 0.0
    assert savings.by_category(events).count() == 1


def test_index(spark):
    from datetime import datetime

    cols = "project_root string, file_path string, file_hash string, mtime timestamp_ntz"
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    meta = spark.createDataFrame([("r", "a", "1", t1), ("r", "b", "2", t1), ("q", "a", "9", t1)], cols)
    files = spark.createDataFrame([("r", "a", "1", t1), ("r", "b", "2", t2), ("r", "c", "3", t2)], cols)
    assert {r["file_path"]: r["action"] for r in index.to_refresh(files, meta).collect()} == {"a": "skip", "b": "touch", "c": "index"}
    assert {tuple(r)[:2] for r in index.purge(meta, files).collect()} == {("r", "a"), ("r", "b")}
    new = index.upsert(meta, files, index.KEYS, "mtime")
    assert {tuple(r)[:3] for r in new.collect()} == {("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3"), ("q", "a", "9")}
    assert index.expire(files, t2, 0, "mtime").count() == 2 and index.evict(files, 1, "mtime", "file_path").first()["file_path"] == "b"
    assert index.invalidate(files, files.filter("file_path = 'a'"), index.KEYS).count() == 2
    assert index.row_counts(files, meta).first()["rows"] == 6


def test_search_falls_back_to_similar_names(spark):
    symbols = spark.createDataFrame([("AuthService", "a.py", 3), ("auth_service", "b.py", 9), ("Other", "c.py", 1)], "name string, file_path string, line int")
    assert [r["match"] for r in search.search(symbols, "auth").collect()] == ["like", "like"]
    assert [(r["name"], r["match"]) for r in search.search(symbols, "AuthServise").collect()] == [("AuthService", "fuzzy"), ("auth_service", "fuzzy")]
    assert search.search(symbols, " ").count() == 0 and search.search(symbols, "Other", exact_only=True).first()["line"] == 1


def test_smart_read(spark):
    body = "\n".join(f"line {i}" for i in range(1, 121)) + "\n"
    files = spark.createDataFrame(
        [("a.txt", 999, body, False), ("b.py", 40, "def f(x):\n    return x\n\n\ny = f(1)\n", False), ("d", None, None, True), ("k.pem", 3, "key", False), ("p.png", 3, "\x00", False), ("yarn.lock", 9, "a@1:\n  v\n", False), ("big.txt", 10**8, "z", False)],
        "file_path string, length long, text string, is_dir boolean",
    )
    ask_ = "request_id long, file_path string, force_full boolean, query string, start_line int, end_line int, symbol string"
    rows = [
        (1, "a.txt", None, None, None, None, None), (2, "a.txt", None, None, None, None, None), (3, "a.txt", None, None, 41, None, None), (4, "b.py", None, None, None, None, "f"),
        (5, "b.py", None, None, None, None, "y ="), (6, "d", None, None, None, None, None), (7, "k.pem", None, None, None, None, None), (8, "k.pem", True, None, None, None, None),
        (9, "p.png", None, None, None, None, None), (10, "yarn.lock", None, "a", None, None, None), (11, "big.txt", None, None, None, None, None), (12, "none", None, None, None, None, None), (13, "b.py", None, None, None, None, "zz"),
    ]
    got = {r["request_id"]: r for r in smart_read.answer(spark.createDataFrame(rows, ask_), files).collect()}
    assert len(got) == len(rows)
    assert (got[1]["status"], got[1]["detail"], got[1]["last"], got[1]["next_start"], got[1]["next_end"]) == ("CACHED", "FIRST_READ", 40, 41, 80)
    assert (got[2]["detail"], got[2]["body"]) == ("UNCHANGED", None)
    assert (got[3]["status"], got[3]["first"], got[3]["last"], got[3]["next_start"], got[3]["next_end"]) == ("SLICE", 41, 80, 81, 120)
    assert (got[4]["detail"], got[4]["body"]) == ("OK", "1: def f(x):\n2:     return x")
    assert (got[5]["detail"], got[5]["first"]) == ("BY_TEXT", 5)
    assert [got[i]["status"] for i in (6, 7, 8, 9, 11, 12)] == ["DIRECTORY", "SECRET", "FULL", "BINARY", "TOO_LARGE", "MISSING"]
    assert (got[10]["status"], got[10]["detail"], got[10]["body"]) == ("LOCKFILE", "found", "a@1:\n  v")
    assert got[13]["detail"] == "NOT_FOUND"


def test_context_of_one_line_by_lines(spark):
    df = spark.createDataFrame([("go.sum", "a" * 500 + " Needle " + "b" * 500, "needle"), ("go.sum", "1\nneedle\n3", "needle")], "file_name string, content string, query string")
    got = [r["context"] for r in lockfile.ask(df, whole_lines=True).orderBy(F.desc(F.length("content"))).collect()]
    assert [(r["first"], r["last"]) for r in got] == [(1, 1), (1, 3)] and len(got[0]["body"]) == 1008


def test_inbound_of_few_names_shuffles_no_pairs(spark):
    rows = [(1, "alpha_beta alphabet 'x-ray' a.b()"), (2, None), (3, "x-ray alphax alpha"), (3, "alpha"), (4, "->-> ÿalphaÿ\x1c\x1d\x1ez"), (None, "alpha")]
    files = spark.createDataFrame(rows, "file_path long, text string")
    named = spark.createDataFrame([("alpha", 1), ("alphabet", 3), ("x-ray", 4), (".b(", 2), ("->->", 1), ("\x1c\x1d\x1e", 2), ("nope", 1), (None, 1)], "name string, def_file long")
    want = sorted(tuple(r) for r in repomap.inbound_naive(files, named).collect())
    few = repomap.inbound(files, named)
    assert sorted(tuple(r) for r in few.collect()) == want == [(1, 4), (2, 2), (3, 1), (4, 2)]
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(def_file") >= 1 and "Join" not in few._jdf.queryExecution().executedPlan().toString()
    once = files.filter("text != 'alpha' OR file_path IS NULL")
    assert sorted(tuple(r) for r in repomap.inbound(once, named, few=0).collect()) == sorted(tuple(r) for r in repomap.inbound_naive(once, named).collect())


def test_words_of_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of a table that is small on disk, whose texts are made: Spark expects little of their words, but they may be any number."""
    spark.range(3000).select(F.col("id").alias("n")).write.parquet(f"{tmp_path}/n")
    files = spark.read.parquet(f"{tmp_path}/n").select(F.concat(F.lit("m"), "n", F.lit(".py")).alias("file_path"), F.concat(F.lit("call run"), F.col("n") % 500, F.lit(" and $run"), F.col("n") % 500).alias("text"))
    named = spark.range(500).select(F.concat(F.lit("run"), "id").alias("name"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("def_file"))
    want = sorted(tuple(r) for r in repomap.inbound(files, named).collect())
    assert len(want) == 500
    for most in (0, 50_000):  # the names' words are many, or few and sent
        monkeypatch.setattr(repomap, "FEW_NAMES", most)
        rows = repomap.inbound(files, named, few=0)
        assert sorted(tuple(r) for r in rows.collect()) == want
        joins = re.findall(r"BroadcastHashJoin .*", rows._jdf.queryExecution().toString())
        assert joins if most else not joins
        assert not any("BuildLeft" in j for j in joins)
