"""The parallel scan of logs against the row form, on logs cut into chunks anywhere, and on files of many splits."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import logs, logscan
from siftwork.sources import files

LINES = {
    "pytest": ["collected 12 items", "rootdir: /x", "tests/a.py::t PASSED [ 5%]", "tests/b.py::u FAILED [ 9%]", "=== FAILURES ===", "E   assert 1", "== 3 passed in 2s ==", "7 failed in 1s", "  ", "plain", "pytest test session starts"],
    "cargo": ["   Compiling x v1", "test a ... ok", "test result: ok. 3 passed", "error: no", "failures:", "  warning: w", "note", "", "thread panicked"],
    "pytest-states": ["=== FAILURES ===", "  === short test summary info ===", "tests/a.py::t.PASSED", "tests/b.py [100%]", "FAILED tests/x", "rootdir: y", ".....F.....PASSED", "AssertionError: 1", "other", "2 passed in 1s"],
    "npm": ["npm http fetch GET 200", "added 3 packages", "[1/4] Resolving", "yarn install", "an error", ""],
    "go": ["=== RUN   TestA", "--- PASS: TestA", "PASS", "--- FAIL: TestB", "   ", "ok pkg"],
    "git": ["On branch main", '  (use "git add" to update)', "hint: pull", "modified: a (use 'git x' there)"],
    "none": ["some text", "\x1b[31mred error\x1b[0m", "", "Traceback (most recent call last):", "\t"],
}


def logs_of():
    r = random.Random(4)
    out = []
    for kind, lines in LINES.items():
        for k in range(14):
            few = r.sample(lines, r.randint(1, len(lines)))
            body = [r.choice(few) for _ in range(r.choice([1, 2, 5, 40]))]
            hint = [kind, "auto", None][k % 3] if kind != "none" else "auto"
            out.append((f"{kind}{k}", hint, [0, 1, None][k % 3 if k < 9 else 1], k == 13, "\n".join(body)))
    out += [("blank", "npm", 1, False, " \n\n"), ("empty", "auto", 0, False, ""), ("trace", "pytest", 0, False, "\n  \npytest collected\nTraceback (most recent call last):\n x \n\n"), ("head", "auto", 0, False, "x\n" * 40 + "git log"), ("late", "auto", 0, False, "x\n" * 60 + "git log")]
    return out


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(logs_of(), "log_id string, type_hint string, exit_code int, bypass boolean, raw string")


def lines_of(given, per_chunk):
    rows = given.select("log_id", F.posexplode(F.split("raw", "\n", -1)).alias("pos", "line"))
    return rows.select("log_id", F.expr(f"pos div {per_chunk}").cast("long").alias("chunk"), F.col("pos").cast("long"), "line")


@pytest.mark.parametrize("per_chunk", [1, 3, 1000])
def test_scan_equals_the_row_form(given, per_chunk):
    want = {r["log_id"]: r for r in logs.prune(given).collect()}
    out, told = logscan.prune_lines(lines_of(given, per_chunk).repartition(3), given)
    kept = {}
    for r in sorted(out.collect(), key=lambda r: (r["log_id"], r["line_no"])):
        kept.setdefault(r["log_id"], []).append(r["line"])
    rows = {r["log_id"]: r for r in told.collect()}
    assert set(rows) == set(want)
    for i, w in want.items():
        assert ("\n".join(kept.get(i, [])), rows[i]["kind"], rows[i]["guard"], rows[i]["orig_tokens"], rows[i]["new_tokens"], rows[i]["saved_pct"]) == (w["filtered"], w["kind"], w["guard"], w["orig_tokens"], w["new_tokens"], w["saved_pct"]), i
    assert {w["guard"] for w in want.values()} == {None, "error", "empty", "bypass"}


@pytest.mark.parametrize("most, head, tail", [(20, 12, 5), (50, 30, 20), (10_000, 5, 5), (7, 0, 3)])
def test_guard_at_reading_equals_the_row_form(given, most, head, tail):
    want = {r["log_id"]: r["g"] for r in given.select("log_id", logs.guard_length(F.col("raw"), most, head, tail).alias("g")).collect()}
    for per_chunk in (1, 4):
        got = {r["log_id"]: r["raw"] for r in logscan.guarded(lines_of(given, per_chunk), most, head, tail).collect()}
        assert got == want


def test_a_file_of_many_splits(spark, tmp_path):
    r = random.Random(9)
    raw = "\n".join(r.choice(LINES["cargo"]) for _ in range(30_000))
    (tmp_path / "build.log").write_text(raw)
    (tmp_path / "small.log").write_text("error: one\nnote\ntest result: ok. 1 passed\nnote")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = files.read_log_lines(spark, str(tmp_path))
        assert lines.select("log_id", "chunk").distinct().count() > 5
        out, told = logscan.prune_lines(lines)
        got = {}
        for x in sorted(out.collect(), key=lambda x: x["line_no"]):
            got.setdefault(x["log_id"].rsplit("/", 1)[1], []).append(x["line"])
        # a task's part of the lines is bounded by the split
        assert max(x["n"] for x in logscan._placed(lines).groupBy("log_id", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()) < 10_000
        cut = {x["log_id"].rsplit("/", 1)[1]: x["raw"] for x in logscan.guarded(lines, 50_000, 20_000, 9_000).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    rows = spark.createDataFrame([(n, None, 0, False, (tmp_path / n).read_text()) for n in ("build.log", "small.log")], "log_id string, type_hint string, exit_code int, bypass boolean, raw string")
    assert {n: "\n".join(x) for n, x in got.items()} == {x["log_id"]: x["filtered"] for x in logs.prune(rows, most=10**9).collect()}
    assert cut == {x["log_id"]: x["g"] for x in rows.select("log_id", logs.guard_length(F.col("raw"), 50_000, 20_000, 9_000).alias("g")).collect()}
    assert {x["kind"] for x in told.collect()} == {"cargo_test"}


def test_no_lines(given):
    out, told = logscan.prune_lines(lines_of(given, 3).limit(0), given)
    assert out.count() == 0 and told.count() == 0 and logscan.guarded(lines_of(given, 3).limit(0)).count() == 0


def test_a_task_sorts_a_bounded_part_and_lines_move_once(given, monkeypatch):
    lines = lines_of(given, 3)
    monkeypatch.setattr(logscan, "TASK_LINES", 100)
    assert logscan._dealt(lines).rdd.getNumPartitions() == -(-lines.count() // 100) > 4
    placed = logscan._placed(lines)
    known = logscan._chunks(placed).select("log_id", "chunk", "first")
    plan = lambda: logscan._with_chunks(placed, known)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan() and "BroadcastHashJoin" in plan()
    few = logscan._with_chunks(placed, known).count()
    monkeypatch.setattr(logscan, "SENT_CHUNKS", 10)  # more chunks than are sent: the lines are dealt as before
    assert "BroadcastHashJoin" not in plan() and logscan._with_chunks(placed, known).count() == few == lines.count()
    test_scan_equals_the_row_form(given, 3)


def test_totals_are_taken_without_a_sort_of_lines(spark, given):
    placed = logscan._placed(lines_of(given, 3))
    chunks = logscan._chunks(placed)
    kinds = logscan._kinds(placed, chunks, given)
    totals, plans = logscan.written, []
    try:
        logscan.written = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), totals(df))[1]
        logscan._totals(logscan._scanned(placed, chunks.select("log_id", "chunk", "first", *(f"start_{k}" for k in logscan.EVENTS)).join(kinds.select("log_id", "kind"), "log_id"))).collect()
    finally:
        logscan.written = totals
    assert len(plans) == 1 and "SortAggregate" not in plans[0] and "HashAggregate" in plans[0]
