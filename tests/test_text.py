"""Paging, slices, estimates and line rules against plain loops."""

import random

from pyspark.sql import functions as F

from siftwork.functions import scalars
from siftwork.operators import text

EDGES = ["", "a", "a\n", "\n", "a\r\nb\r\n", "é😀\nx", "y" * 3000, "y" * 3000 + "\nz", "\n".join("l" * 10 for _ in range(40)), "\n".join("l" * 10 for _ in range(41)), "\n".join("w" * 99 for _ in range(60))]


def plain_lines(t):
    parts = t.replace("\r\n", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def plain_page(lines):
    n = used = 0
    for x in lines:
        if n >= 40 or (n and used + len(x) > 2500):
            break
        used, n = used + len(x) + 1, n + 1
    return n


def texts():
    r = random.Random(3)
    return EDGES + ["\n".join("q" * r.randint(0, 300) for _ in range(r.randint(0, 90))) for _ in range(60)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_pages(spark):
    cases = texts()
    got = {r["doc_id"]: r for r in text.first_page(frame(spark, cases)).collect()}
    starts = {r[0]: r[1] for r in frame(spark, cases).select("doc_id", text.page_starts(text.lines_of("text"))).collect()}
    for i, t in enumerate(cases):
        lines = plain_lines(t)
        end = plain_page(lines)
        assert (got[i]["total_lines"], got[i]["page_end"]) == (len(lines), end)
        assert (got[i]["next_start"], got[i]["next_end"]) == ((end + 1, min(end + 40, len(lines))) if end < len(lines) else (None, None))
        at, want = 0, []
        while at < len(lines):
            want.append(at + 1)
            at += plain_page(lines[at:])
        assert starts[i] == want


def test_slices(spark):
    cases = texts()
    for first, last in ((1, 5), (None, 3), (3, None), (50, 60), (5, 2), (-4, 2)):
        got = text.slice_lines(frame(spark, cases), F.lit(first).cast("int"), F.lit(last).cast("int")).collect()
        for r in got:
            lines = plain_lines(cases[r["doc_id"]])
            a, b = max(1, first if first is not None else 1), min(len(lines), last if last is not None else len(lines))
            if not lines:
                assert r["status"] == "EMPTY"
            elif a > len(lines):
                assert r["status"] == "START_BEYOND_END"
            elif a > b:
                assert r["status"] == "INVALID_RANGE"
            else:
                shown = [f"{i}: {x}" for i, x in enumerate(lines[a - 1 : b], a)]
                shown = shown[: plain_page(shown)]
                assert (r["status"], r["body"], r["page_end"]) == ("OK", "\n".join(shown), a + len(shown) - 1)


def test_estimates(spark):
    cases = ["", "abc", "abcdefgh", "def f(): pass", "x" * 501 + "{", "plain words only"]
    got = frame(spark, cases).select("text", scalars.est_chars4("text"), scalars.est_ratio("text"), scalars.est_ratio("text", "claude")).collect()
    for t, chars, auto, family in got:
        code = any(m in t[:500] for m in scalars.CODE_MARKS)
        assert chars == (max(1, len(t) // 4) if t else 0)
        assert auto == (max(1, int(len(t) / (3.2 if code else 3.8))) if t else 0)
        assert family == (max(1, int(len(t) / 3.3)) if t else 0)


def test_similarity_thresholds(spark):
    pairs = [("Auth", "auth"), ("get_user", "getUser"), ("getUser", "getUserById"), ("fetch_data", "fetchdate"), ("apple", "zzzzqqqq")]
    got = [r[0] for r in spark.createDataFrame(pairs, "q string, t string").select(scalars.similarity("q", "t")).collect()]
    assert got[0] == 1.0 and got[1] >= 0.95 and got[2] >= 0.85 and got[3] >= 0.8 and got[4] < 0.4
    back = [r[0] for r in spark.createDataFrame(pairs, "q string, t string").select(scalars.similarity("t", "q")).collect()]
    assert got == back


def test_ansi_and_keys(spark):
    row = spark.createDataFrame([("\x1b[32mok\x1b[0m\r\n", "C:\\a\\b.py#L1-2#x")], "t string, k string")
    got = row.select(scalars.strip_ansi("t"), scalars.key_base("k"), scalars.key_fragment("k")).first()
    assert tuple(got) == ("ok\n", "C:/a/b.py", "L1-2#x")


def test_exact_counts(spark):
    import pytest

    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    from siftwork.functions import tokens

    path = public.path("byte_bpe_50k.json")
    by = library.Tokenizer.from_file(path)
    texts = ["hello world", "", None, "def f(x):\n    return x", "é😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.count("t", path=path).alias("n"), tokens.count("t", "claude").alias("e")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [None if t is None else len(by.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r["e"] for r in rows] == [None if t is None else 0 if not t else max(1, int(len(t) / 3.3)) for t in texts]


def test_many_pages_start_where_a_plain_pass_says(spark):
    """More pages than are gathered at once."""
    from pyspark.sql import functions as F

    from siftwork.functions import scalars
    from siftwork.operators import text

    n = scalars.GATHERED * 9 + 5
    lines = ["x" * (i % 7) for i in range(n * 3)]
    starts, held, chars = [], 0, 0
    for i, x in enumerate(lines):
        if held and held < 3 and chars + len(x) <= 9:
            held, chars = held + 1, chars + len(x) + 1
        else:
            starts.append(i + 1)
            held, chars = 1, len(x) + 1
    got = spark.createDataFrame([(lines,), ([],)], "lines array<string>").select(text.page_starts(F.col("lines"), 3, 9).alias("s")).collect()
    assert got[0]["s"] == starts and len(starts) > n and got[1]["s"] == []


def test_words_of_a_long_line_cost_no_search_each(spark):
    """A line of many words, one of them called; its text is kept once a line."""
    import time

    from siftwork.operators import search

    line = " ".join(f"w{i}" for i in range(40_000)) + " xrun(1) run2 ("
    rows = spark.createDataFrame([(1, line), (2, "run from here"), (3, "import a\nrun (x) orun(y) ÿrun(z)")], "doc_id int, text string")
    began = time.time()
    got = search.words_as_occurrences(rows).groupBy("file_path", "line", "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("kind") == "CALL", F.col("name")))).alias("called")).collect()
    assert time.time() - began < 30
    assert {(r["file_path"], r["line"], r["kind"]): r["n"] for r in got} == {(1, 1, "USAGE"): 40_002, (1, 1, "CALL"): 1, (2, 1, "IMPORT"): 3, (3, 1, "IMPORT"): 2, (3, 2, "USAGE"): 3, (3, 2, "CALL"): 3}
    assert search.word_lines(rows).count() == 4
