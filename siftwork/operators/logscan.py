"""Pruning of logs of any length, as tables of lines: a parallel finite-state scan.

A log is cut into chunks of lines (the splits of its file, or runs of its rows). What a filter does to a line depends on
the line and on a state that earlier lines have set; every line sets the state or leaves it. So a chunk's transition
function is either the identity or one state, whatever it starts in: its last event. A first pass gives the transition
functions and the counts of all chunks, in parallel; a prefix over the chunks of a log gives each chunk the state it
starts in, and its first line's number; a second pass decides on the lines. A window is over the lines of one chunk or the
chunks of one log, so no task's work grows with a log. Types, guards and tallies are sums and maxima over lines.

The results are those of logs.prune(), without its cut of long logs; guarded() makes that cut, at reading, for logs that
do not fit a row. Terminal codes are removed line by line, so a title that spans lines stays.

Defined results: null lines count as empty; a log without rows has no result; without a row of settings it is typed by its
lines, as of a command that did not fail; rows of one chunk that are equal in pos may change places; an empty table gives
empty results.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import saved_pct, strip_ansi
from ..sources.files import written
from . import logs

def _holding(x: Column, words: str, met: Callable[[Column], Column]) -> Column:
    """met(x), which is looked at only if x holds one of the words (w|w), as a pattern costs much more than that."""
    return F.when(reduce(lambda a, b: a | b, (x.contains(w) for w in words.split("|"))), met(x)).otherwise(F.lit(False))


def _starts(x: Column, words: str) -> Column:
    return _holding(x, words, lambda y: logs.line_starts(y, words))


#: The machines: the state that a line sets; null if it leaves the state.
EVENTS = {
    "pytest": lambda x: F.when(_holding(x, "FAILURES|ERRORS|short test summary info|ERROR collecting ", lambda y: y.rlike(logs.PYTEST_HEADER)), 1),
    "cargo_test": lambda x: F.when(_starts(x, logs.CARGO_RESULT), 0).when(_starts(x, logs.CARGO_FAILURE), 1),
    "pytest_states": lambda x: F.when(_starts(x, logs.STATE_ON), 1).when(_starts(x, logs.STATE_OFF), 0),
}
#: Lines that a task sorts, about; chunks that are sent to all tasks at most, some 100 MB. Lines meet more chunks by a shuffle.
TASK_LINES, SENT_CHUNKS = 500_000, 500_000
#: Lines at a log's start that its first 100 characters can touch.
HEAD_LINES, HEAD_CHARS = 100, 100
#: What a run's own tally tells the numbers of.
TOLD = ("passed", "failed")
#: Characters of which one is in every terminal code.
CODES = ("\x1b", "\r")
WHITE = r"(?U)^\s*$"


@contextlib.contextmanager
def _small_methods(spark: SparkSession):
    """Plans that run inside have no generated method that is too long for the JVM to compile: the many patterns of a line would be interpreted."""
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), 8000)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _dealt(lines: DataFrame) -> DataFrame:
    """log_id, chunk, pos, line by chunks, in as many parts as the lines need, so that a task's part does not grow with them."""
    rows = lines.select("log_id", "chunk", "pos", F.coalesce("line", F.lit("")).alias("line"))
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_LINES))
    return rows.repartition(parts, "log_id", "chunk")


def _with_chunks(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The lines with what is known of their chunks, of which there are few: lines are only moved if they are not."""
    n = chunks.count()
    if n <= SENT_CHUNKS:
        return placed.join(F.broadcast(chunks), ["log_id", "chunk"])
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // TASK_LINES))
    return placed.repartition(parts, "log_id", "chunk").join(chunks.hint("merge"), ["log_id", "chunk"])


def _placed(lines: DataFrame) -> DataFrame:
    """log_id, chunk, n (in the chunk), line, bare (without terminal codes, null if it has none), at (its start in the chunk's raw text), and the state that the chunk's lines up to it have set, by machine. Written; text is bare or line."""
    coded = reduce(lambda a, b: a | b, (F.col("line").contains(x) for x in CODES))
    rows = _dealt(lines).withColumn("bare", F.when(coded, strip_ansi("line"))).withColumn("text", F.coalesce("bare", "line"))
    order = Window.partitionBy("log_id", "chunk").orderBy("pos", "line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    states = [F.last(event(F.col("text")).cast("int"), ignorenulls=True).over(so_far).alias(f"set_{kind}") for kind, event in EVENTS.items()]
    at = (F.sum(F.length("line") + 1).over(so_far) - F.length("line") - 1).alias("at")
    return written(rows.select("log_id", "chunk", F.row_number().over(order).cast("long").alias("n"), "line", "bare", at, *states)).withColumn("text", F.coalesce("bare", "line"))


def _chunks(placed: DataFrame) -> DataFrame:
    """A row a chunk: lines and characters, its transition function by machine, marks; with first (lines before it), start (characters before it) and the states it starts in. Written."""
    met = logs.marks(F.concat("text", F.lit("\n")))
    functions = [F.max_by(f"set_{k}", "n").alias(f"set_{k}") for k in EVENTS]
    rows = placed.groupBy("log_id", "chunk").agg(F.max("n").alias("rows"), F.sum(F.length("line") + 1).alias("chars"), *functions, *(F.bool_or(c).alias(f"mark_{m}") for m, c in met.items()))
    earlier = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("log_id")
    starts = [F.coalesce(F.last(f"set_{k}", ignorenulls=True).over(earlier), F.lit(0)).alias(f"start_{k}") for k in EVENTS]
    return written(
        rows.select(
            "log_id", "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("start"),
            F.sum("rows").over(whole).alias("n_lines"), (F.sum("chars").over(whole) - 1).alias("n_chars"), *starts, *(F.bool_or(f"mark_{m}").over(whole).alias(f"mark_{m}") for m in met),
        )
    )


def _kinds(placed: DataFrame, chunks: DataFrame, settings: DataFrame | None) -> DataFrame:
    """A row a log: kind, exit_code, bypass, and whether it is kept whole, trimmed, for its traceback."""
    heads = _with_chunks(placed.filter(F.col("n") <= HEAD_LINES), chunks.filter(F.col("first") < HEAD_LINES).select("log_id", "chunk", "first")).filter(F.col("first") + F.col("n") <= HEAD_LINES)
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("first") + F.col("n")).alias("n"), F.substring("text", 1, HEAD_CHARS).alias("t")))), lambda x: x["t"]), "\n")
    rows = chunks.filter("first = 0").join(heads.groupBy("log_id").agg(F.substring(head, 1, HEAD_CHARS).contains("git ").alias("_git")), "log_id", "left")
    if settings is None:
        rows = rows.withColumns({"type_hint": F.lit(None).cast("string"), "exit_code": F.lit(0), "bypass": F.lit(False)})
    else:
        rows = rows.join(settings.select("log_id", "type_hint", "exit_code", "bypass"), "log_id", "left")
    bypass = F.coalesce("bypass", F.lit(False))
    m = {x: F.col(f"mark_{x}") for x in logs.marks(F.lit(""))}
    kind = F.when(bypass, "generic").otherwise(logs.type_by(m, F.col("type_hint"), F.coalesce("_git", F.lit(False))))
    bare = m["traceback"] & ~m["section"] & (F.col("kind") == "pytest")
    rows = rows.select("log_id", "n_lines", "n_chars", F.coalesce("exit_code", F.lit(0)).alias("exit_code"), bypass.alias("bypass"), kind.alias("kind"), *(f"mark_{x}" for x in ("traceback", "section")))
    return rows.withColumn("kind", F.when(bare, "traceback").otherwise(F.col("kind"))).drop("mark_traceback", "mark_section")


def _stays(text: Column, state: Column) -> Column:
    """Whether the filter of a log's kind keeps a line."""
    within = lambda kept: F.when(state == 1, True).otherwise(kept)
    out = F.when(F.col("kind") == "pytest", within(_holding(text, "collected |test session starts|platform |rootdir:|E   |Error:|Exception:", logs.pytest_kept)))
    out = out.when(F.col("kind") == "cargo_test", within(_starts(text, f"{logs.CARGO_RESULT}|{logs.CARGO_WARNING}")))
    out = out.when(F.col("kind") == "pytest_states", within(_holding(text, f"{logs.STATE_KEPT}|{logs.STATE_TOLD}|passed in", logs.states_kept)))
    for name, pattern in logs.DROPPED.items():
        out = out.when(F.col("kind") == name, ~text.rlike(pattern))
    return out.otherwise(F.lit(True))


def _shown(text: Column) -> Column:
    return F.when(F.col("kind") == "git", F.regexp_replace(text, logs.GIT_HINT, "")).otherwise(text)


def _scanned(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines with their number in the log (line_no), the state they are in, whether they stay, and as what; chunks: with kind."""
    rows = _with_chunks(placed, chunks)
    state = reduce(lambda out, k: out.when(F.col("kind") == k, F.coalesce(f"set_{k}", f"start_{k}")), EVENTS, F.when(F.lit(False), 0)).otherwise(0)
    rows = rows.withColumn("line_no", F.col("first") + F.col("n")).withColumn("state", state)
    return rows.withColumn("stays", _stays(F.col("text"), F.col("state"))).withColumn("shown", _shown(F.col("text")))


def _filled(x: Column) -> Column:
    """Whether a line is not blank; most lines tell by their first character."""
    return F.when((x >= "!") & (x < "\x7f"), True).otherwise(~x.rlike(WHITE))


def _totals(rows: DataFrame) -> DataFrame:
    """A row a log: what the guards and the tallies need. Patterns of a kind are branches of a case, so lines of other kinds do not meet them."""
    x, stays, outside, kind = F.col("text"), F.col("stays"), F.col("state") == 0, F.col("kind")
    said = lambda word: _holding(x, word, lambda y: logs.pytest_said(y, word))
    number = lambda word: F.regexp_extract(x, rf"(\d+)\s+{word}", 1)
    told = F.when((kind == "pytest") & outside, _holding(x, "passed in |failed in |passed,", logs.pytest_told))
    passed = F.when((kind == "pytest") & outside, said("PASSED"))
    passed = passed.when((kind == "pytest_states") & outside, _holding(x, "PASSED|[100%]", lambda y: logs.states_going(y) & ~logs.line_starts(y, logs.STATE_KEPT)))
    failed = F.when((kind == "pytest") & outside, F.when(said("FAILED"), ~said("PASSED")))
    failed = failed.when(kind == "pytest_states", _starts(x, "FAILED "))
    error = logs.has_error(x)
    seen = rows.select(
        "log_id", "line_no", "state", "stays", error.alias("error"), F.when(kind == "git", F.when(stays, logs.has_error(F.col("shown")))).when(stays, error).alias("shows"), _filled(x).alias("filled"),
        F.when(stays, F.when(kind == "git", _filled(F.col("shown"))).otherwise(_filled(x))).alias("kept_filled"), passed.alias("passed"), failed.alias("failed"),
        *(F.when(told, F.when(number(word) != "", F.col("line_no"))).alias(f"{word}_at") for word in TOLD),
    )
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    # all of it of fixed size, so Spark needs no sort; the few texts that are told are fetched by their lines
    totals = written(seen.groupBy("log_id").agg(
        F.count_if("stays").alias("n_kept"),
        some("error").alias("had_error"),
        some("shows").alias("has_error"),
        some("kept_filled"),
        F.min(F.when(F.col("filled"), F.col("line_no"))).alias("from_line"),
        F.max(F.when(F.col("filled"), F.col("line_no"))).alias("to_line"),
        F.count_if("passed").alias("n_passed"),
        F.count_if("failed").alias("n_failed"),
        F.bool_or(F.col("state") == 1).alias("in_section"),
        *(F.min(f"{word}_at").alias(f"{word}_at") for word in TOLD),
    ))
    asked = F.explode(F.array(*(F.struct(F.lit(word).alias("word"), F.when((F.col(f"n_{word}") == 0) & ~F.col("in_section"), F.col(f"{word}_at")).alias("line_no")) for word in TOLD)))
    asked = totals.select("log_id", asked.alias("x")).select("log_id", "x.*").filter("line_no IS NOT NULL")
    if asked.isEmpty():
        return totals.withColumns({f"told_{word}": F.lit(None).cast("string") for word in TOLD})
    lines = rows.select("log_id", "line_no", "text").filter(x.contains("passed") | x.contains("failed")).join(asked, ["log_id", "line_no"])
    texts = lines.groupBy("log_id").agg(*(F.max(F.when(F.col("word") == word, number(word))).alias(f"told_{word}") for word in TOLD))
    return totals.join(texts, "log_id", "left")


def _decided(kinds: DataFrame, totals: DataFrame) -> DataFrame:
    """A row a log: kind, mode (which lines are given: raw, whole, trimmed or kept), tally and guard."""
    t = kinds.join(totals, "log_id")
    number = lambda n, told: F.when(F.col(n) > 0, F.col(n).cast("string")).otherwise(F.coalesce(told, F.lit("0")))
    tally = F.when((F.col("kind") == "pytest") & ~F.col("in_section"), F.concat(F.lit("pytest: "), number("n_failed", F.col("told_failed")), F.lit(" FAILED, "), number("n_passed", F.col("told_passed")), F.lit(" passed")))
    tally = tally.when((F.col("kind") == "pytest_states") & (F.col("n_kept") > 0), F.concat(F.lit("pytest: "), F.col("n_failed").cast("string"), F.lit(" FAILED, "), F.col("n_passed").cast("string"), F.lit(logs.STATE_TALLY)))
    t = t.withColumn("tally", tally)
    none = F.col("kind").isin("cargo_test", "pytest_states") & (F.col("n_kept") == 0)
    mode = F.when(F.col("bypass"), "raw").when(F.col("kind") == "traceback", "trimmed").when((F.col("kind") == "generic") | none, "whole").otherwise("kept")
    t = t.withColumn("mode", mode)
    whole = F.col("mode") != "kept"
    blank = F.when(whole, F.col("from_line").isNull()).otherwise(~F.col("kept_filled") & F.col("tally").isNull())
    # a tally tells of failures by its own word
    error = F.when(whole, F.col("had_error")).otherwise(F.col("has_error") | F.coalesce(logs.has_error(F.col("tally")), F.lit(False)))
    lost = (F.col("exit_code") != 0) & ((F.col("had_error") & ~error) | blank)
    t = t.withColumn("guard", F.when(F.col("bypass"), "bypass").when(lost, "error").when(blank & F.col("from_line").isNotNull(), "empty"))
    t = t.withColumn("mode", F.when(F.col("guard").isin("error", "empty"), "trimmed").otherwise(F.col("mode"))).withColumn("tally", F.when(F.col("mode") == "kept", F.col("tally")))
    return t.select("log_id", "kind", "mode", "guard", "tally", "n_lines", "n_chars", "from_line", "to_line")


def _tokens(chars: Column) -> Column:
    return F.when(chars <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(chars / 4))).cast("long")


def _pruned(lines: DataFrame, settings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The lines that stay, and a row a log: what is decided. Both written."""
    placed = _placed(lines)
    chunks = _chunks(placed)
    kinds = written(_kinds(placed, chunks, settings))
    where = chunks.drop("n_lines", "n_chars", *(f"mark_{m}" for m in logs.marks(F.lit(""))))
    # what is known of a log goes to its chunks first, so no line is dealt by its log
    decided = written(_decided(kinds, _totals(_scanned(placed, where.join(kinds.select("log_id", "kind"), "log_id")))))
    rows = _scanned(placed, where.join(decided, "log_id"))
    mode = F.col("mode")
    rows = rows.filter((mode != "kept") | F.col("stays")).filter((mode != "trimmed") | F.col("line_no").between(F.col("from_line"), F.col("to_line")))
    cut = F.when(F.col("line_no") == F.col("from_line"), F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text"))
    cut = F.when(F.col("line_no") == F.col("to_line"), F.regexp_replace(cut, r"(?U)\s+$", "")).otherwise(cut)
    line = F.when(mode == "raw", F.col("line")).when(mode == "kept", F.col("shown")).when(mode == "trimmed", cut).otherwise(F.col("text"))
    out = rows.select("log_id", "line_no", line.alias("line"))
    out = written(out.unionByName(decided.filter("tally IS NOT NULL").select("log_id", (F.col("n_lines") + 1).alias("line_no"), F.col("tally").alias("line"))))
    return out, decided


def prune_lines(lines: DataFrame, settings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines that stay (log_id, line_no, line) and a row a log: log_id, kind, guard, n_lines, n_kept, orig_tokens, new_tokens, saved_pct.

    lines: log_id, chunk, pos, line; chunks of a log follow each other by number, lines of a chunk by pos. settings:
    log_id, type_hint, exit_code, bypass. A tally is a line after a log's last one.
    """
    with _small_methods(lines.sparkSession):
        out, decided = _pruned(lines, settings)
    sums = out.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_kept"), (F.sum(F.length("line") + 1) - 1).alias("_chars"))
    told = decided.join(sums, "log_id", "left").withColumn("orig_tokens", _tokens(F.col("n_chars"))).withColumn("new_tokens", _tokens(F.coalesce("_chars", F.lit(0))))
    percent = F.round(saved_pct("orig_tokens", "new_tokens"), 6).alias("saved_pct")
    return out, told.select("log_id", "kind", "guard", "n_lines", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "orig_tokens", "new_tokens", percent)


def guarded(lines: DataFrame, most: int = logs.MOST_CHARS, head: int = logs.HEAD_CHARS, tail: int = logs.TAIL_CHARS) -> DataFrame:
    """log_id, raw: the text that logs.guard_length() leaves of each log, of which only the start and the end of a long one are put together.

    So a log of any length becomes a row of bounded length, which logs.prune() takes.
    """
    order = Window.partitionBy("log_id", "chunk").orderBy("pos", "line")
    rows = _dealt(lines)
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(rows.select("log_id", "chunk", "line", F.row_number().over(order).alias("n"), before.alias("at")))
    chunks = placed.groupBy("log_id", "chunk").agg(F.sum(F.length("line") + 1).alias("chars"))
    by = Window.partitionBy("log_id")
    earlier = by.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("log_id", "chunk", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("start"), (F.sum("chars").over(by) - 1).alias("total"))
    rows = _with_chunks(placed, chunks)
    at, piece, total = F.col("start") + F.col("at"), F.concat("line", F.lit("\n")), F.col("total")
    # of each line the characters below head and those from total - tail on, its newline being one of them
    first = F.when(at < head, F.substring(piece, F.lit(1), (F.lit(head) - at).cast("int")))
    skipped = F.greatest(total - tail - at, F.lit(0)).cast("int")
    last = F.when(at + F.length(piece) > total - tail, F.substring(piece, skipped + 1, F.length(piece)))
    long = total > most
    rows = rows.select("log_id", "chunk", "n", "total", long.alias("long"), F.when(long, first).otherwise(piece).alias("first"), F.when(long, last).alias("last")).filter("first IS NOT NULL OR last IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "n", "first", "last")))  # most characters of a log, or head and tail
    made = rows.groupBy("log_id").agg(parts.alias("parts"), F.any_value("total").alias("total"), F.any_value("long").alias("long"))
    text = lambda of: F.array_join(F.transform("parts", lambda p: p[of]), "")
    gone = (F.col("total") - head - tail).cast("string")
    ends = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)  # noqa: E731  the newline that was put after the last line
    cut = F.concat(text("first"), F.lit("\n\n... [truncated "), gone, F.lit(" characters] ...\n\n"), ends(text("last")))
    return made.select("log_id", F.when(F.col("long"), cut).otherwise(ends(text("first"))).alias("raw"))
