"""Pruning of captured command logs.

A log is guarded against runaway length, stripped of terminal codes and typed; its lines are filtered by the type's
rule, joined again and checked by the error and empty guards. All of it works on the log's own array of lines, so no row
is shuffled: lines that depend on earlier ones (failure sections) are parts of the array before and after a place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import est_chars4, saved_pct, strip_ansi, trim_ws

#: Logs of more characters keep so many of their start and of their end.
MOST_CHARS, HEAD_CHARS, TAIL_CHARS = 2 * 1024 * 1024, 1024 * 1024, 512 * 1024
#: Words of which one in a failed command's log must remain.
ERROR_WORDS = ("traceback", "error", "failed", "exception", "fatal", "panic", "cannot", "syntaxerror", "importerror")
PYTEST_SECTION = r"=+ (FAILURES|ERRORS) =+"
PYTEST_HEADER = r"=+ (FAILURES|ERRORS|short test summary info) =+|^ERROR collecting "
#: Type hints that name a filter; others leave the log as it is.
HINTS = {"pytest": "pytest", "jest": "jest", "vitest": "jest", "go": "go", "npm": "npm", "yarn": "npm", "pnpm": "npm", "cargo": "cargo", "docker": "docker", "maven": "maven", "gradle": "maven", "git": "git", "pytest-states": "pytest_states"}


def guard_length(raw: Column, most: int = MOST_CHARS, head: int = HEAD_CHARS, tail: int = TAIL_CHARS) -> Column:
    """Start and end of a text of more than most characters, with a marker of what is left out between."""
    gone = (F.length(raw) - head - tail).cast("string")
    cut = F.concat(F.substring(raw, 1, head), F.lit("\n\n... [truncated "), gone, F.lit(" characters] ...\n\n"), F.right(raw, F.lit(tail)))
    return F.when(F.length(raw) > most, cut).otherwise(raw)


def marks(log: Column) -> dict[str, Column]:
    """What tells the type of a log, by name; each is true of a log if it is true of one of its lines (with its newline)."""
    low = F.lower(log)
    has = lambda *xs: reduce(lambda a, b: a | b, (log.contains(x) for x in xs))
    return {
        "pytest": has("pytest"), "session": has("test session starts", "collected"), "section": has("FAILURES", "ERRORS") & log.rlike(PYTEST_SECTION),
        "result": has("test result:"), "outcome": has("passed", "failed"),
        "suites": has("Test Suites:"), "jest": low.contains("jest") | low.contains("vitest") | has("✓", "✕"),
        "go": has("=== RUN") & log.rlike(r"(?m)^=== RUN\s+") | has("--- PASS:", "--- FAIL:") & log.rlike(r"(?m)^--- (PASS|FAIL):"),
        "npm": has("npm", "yarn", "pnpm", "node_modules"),
        "compiling": has("Compiling"), "cargo": has("Cargo"), "any_cargo": low.contains("cargo"),
        "step": has("Step "), "docker": has("--->") | low.contains("docker"),
        "maven": has("[INFO] Building", "BUILD SUCCESS", "BUILD FAILED", "Gradle"),
        "git": has("commit", "branch"),
        "ok": has("... ok"), "traceback": has("Traceback (most recent call last):"),
    }


def kind_by(m: dict[str, Column], git_head: Column) -> Column:
    """The first rule that holds of a log's marks; git_head: whether its first 100 characters hold a git command."""
    return (
        F.when(m["pytest"] & m["session"] | m["pytest"] & m["section"], "pytest")
        .when(m["result"] & m["outcome"], "cargo_test")
        .when(m["suites"] & m["jest"], "jest")
        .when(m["go"], "go")
        .when(m["npm"], "npm")
        .when(m["compiling"] & m["cargo"] | m["any_cargo"], "cargo")
        .when(m["step"] & m["docker"], "docker")
        .when(m["maven"], "maven")
        .when(git_head | m["git"], "git")
        .otherwise("generic")
    )


def detect(log: Column) -> Column:
    """The type of a whole log; the first rule that holds."""
    return kind_by(marks(log), F.substring(log, 1, 100).contains("git "))


def type_by(m: dict[str, Column], hint: Column, git_head: Column) -> Column:
    """The filter to use: the hint's, or the detected one for auto and no hint."""
    named = F.create_map(*(F.lit(x) for k, v in HINTS.items() for x in (k, v)))
    kind = F.when(hint.isNull() | (hint == "auto"), kind_by(m, git_head)).otherwise(F.coalesce(named[hint], F.lit("generic")))
    # the build filter leaves logs of test runs to the test filter
    kind = F.when((kind == "cargo") & (m["result"] | m["ok"]), "cargo_test").otherwise(kind)
    return kind


def typed(log: Column, hint: Column) -> Column:
    return type_by(marks(log), hint, F.substring(log, 1, 100).contains("git "))


def has_error(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in ERROR_WORDS))


#: Lines that the stateless filters drop; white space at a line's ends does not count.
DROPPED = {
    "jest": r"(?U:^\s*)PASS|✓",
    "go": r"(?U:^\s*)(?:=== RUN|--- PASS:|PASS(?U:\s*)\z)",
    "npm": r"(?i:^(?:npm |yarn |pnpm ).*(?:fetch|add|install))|^\s*\[[0-9/]+\]\s+|GET|(?i:fetch|download)",
    "cargo": r"^\s*(?:Compiling|Downloaded)\s+",
    "docker": r"(?U:^\s*)(?:--->\s+[a-f0-9]+|---> Using cache(?U:\s*)\z|Removing intermediate container)",
    "maven": r"(?U:^\s*)(?:Downloading from|Downloaded from|Download http|>\s*Task\s+:[a-zA-Z0-9_:]+\s+UP-TO-DATE(?U:\s*)\z)",
    "git": r"""(?U:^\s*)(?:\(use ["']git|hint:)""",
}
#: Hints inside the lines that the git filter keeps.
GIT_HINT = r"""\s*\(use ["']git\s[^)]*\)"""
#: Lines of cargo tests that begin and end a failure, and that stay outside of one.
CARGO_RESULT, CARGO_FAILURE, CARGO_WARNING = "test result:", "error|failures:|----|FAILED", "warning:"


def _from(lines: Column, pattern: str) -> Column:
    """The place of the first line that matches, from 1; one past the end if none does."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True))
    return F.when(at > 0, at).otherwise(F.size(lines) + 1).cast("int")


def pytest_said(x: Column, word: str) -> Column:
    return x.rlike(rf"^.*?\s+{word}\s*\[.*\]$") | x.rlike(rf"\s{word}$") | x.contains(f" {word} ")


def pytest_kept(x: Column) -> Column:
    """Lines of the frame, which stay outside of sections."""
    frame = (
        (x.contains("collected ") & x.contains(" items")) | x.contains("test session starts") | x.startswith("platform ") | x.startswith("rootdir:")
        | x.startswith("E   ") | x.contains("Error:") | x.contains("Exception:")
    )
    return frame & ~pytest_said(x, "PASSED") & ~pytest_said(x, "FAILED")


def pytest_told(x: Column) -> Column:
    """Lines that give the run's own tally."""
    return (x.contains("passed in ") | x.contains("failed in ") | x.contains("passed,")) & ~pytest_said(x, "PASSED") & ~pytest_said(x, "FAILED") & ~pytest_kept(x)


def _pytest(lines: Column) -> Column:
    """Before the first failure section only the frame stays, after it all; without one, a tally follows."""
    first = _from(lines, PYTEST_HEADER)
    before, after = F.slice(lines, F.lit(1), first - 1), F.slice(lines, first, F.size(lines))
    passed, failed = lambda x: pytest_said(x, "PASSED"), lambda x: pytest_said(x, "FAILED")
    kept, told = F.filter(before, pytest_kept), F.filter(before, pytest_told)

    def count(counted: Column, word: str) -> Column:
        number = F.get(F.filter(F.transform(told, lambda x: F.regexp_extract(x, rf"(\d+)\s+{word}", 1)), lambda x: x != ""), F.lit(0))
        return F.when(counted > 0, counted.cast("string")).otherwise(F.coalesce(number, F.lit("0")))

    n_passed, n_failed = F.size(F.filter(before, passed)), F.size(F.filter(before, lambda x: failed(x) & ~passed(x)))
    tally = F.concat(F.lit("pytest: "), count(n_failed, "failed"), F.lit(" FAILED, "), count(n_passed, "passed"), F.lit(" passed"))
    return F.when(first > F.size(lines), F.concat(kept, F.array(tally))).otherwise(F.concat(kept, after))


#: Fixed values of the other form of the pytest filter: sections that begin and end, lines that stay, progress, the tally's end.
STATE_ON, STATE_OFF = "=== FAILURES ===|=== ERRORS ===", "=== short test summary info ==="
STATE_KEPT, STATE_TOLD = "===|rootdir:|collected |FAILED |ERROR ", "warning:|AssertionError"
STATE_PROGRESS = r"(?:tests[/\\\\].*?\s+\[\s*\d+%\]|[.sF]{5,})"
STATE_TALLY = " passed (repetitive logs pruned)"


def line_starts(x: Column, words: str) -> Column:
    return x.rlike(rf"(?U:^\s*)(?:{words})")


def states_going(x: Column) -> Column:
    """Lines of progress, which are counted as passed."""
    ends = lambda word: x.rlike(rf"{word}(?U:\s*)\z")
    return line_starts(x, STATE_PROGRESS) & (ends(r"\.PASSED") | (ends(r"\[100%\]") & ~x.contains("FAILED")))


def states_kept(x: Column) -> Column:
    return line_starts(x, STATE_KEPT) | (~states_going(x) & (line_starts(x, STATE_TOLD) | x.contains("passed in")))


def _pytest_states(log: Column) -> Column:
    """The other form: sections of failures stay whole, until the summary; outside, headings and what failed. Null if none stays."""
    whole = F.regexp_replace(log, r"\r?\n\z", "")
    parts = F.split(whole, rf"\n(?=(?U:[^\S\n]*)(?:{STATE_ON}|{STATE_OFF}))", -1)
    starts, going = line_starts, states_going
    lines = lambda part: F.transform(F.split(part, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    outside = lambda part: F.filter(lines(part), states_kept)
    kept = F.flatten(F.transform(parts, lambda p: F.when(starts(p, STATE_ON), lines(p)).otherwise(outside(p))))
    failed = F.size(F.filter(lines(whole), lambda x: starts(x, "FAILED ")))
    passed = F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(starts(p, STATE_ON), 0).otherwise(F.size(F.filter(lines(p), lambda x: going(x) & ~starts(x, STATE_KEPT)))))
    tally = F.concat(F.lit("pytest: "), failed.cast("string"), F.lit(" FAILED, "), passed.cast("string"), F.lit(STATE_TALLY))
    return F.when(F.size(kept) > 0, F.concat(kept, F.array(tally)))


def _cargo_test(log: Column) -> Column:
    """From an error or failure on all lines stay, until the next result; results and warnings always do. Null if none stays."""
    parts = F.split(log, rf"\n(?=(?U:[^\S\n]*){CARGO_RESULT})", -1)

    def kept(part):
        lines = F.split(part, "\n", -1)
        first = _from(lines, rf"(?U:^\s*)(?:{CARGO_FAILURE})")
        outside = F.filter(F.slice(lines, F.lit(1), first - 1), lambda x: x.rlike(rf"(?U:^\s*)(?:{CARGO_RESULT}|{CARGO_WARNING})"))
        return F.concat(outside, F.slice(lines, first, F.size(lines)))

    every = F.flatten(F.transform(parts, kept))
    return F.when(F.size(every) > 0, every)


def filtered(log: Column, kind: Column) -> Column:
    """The lines that stay of a log of this type, as one text; null where the log stays as it is."""
    lines = F.split(log, "\n", -1)
    out = F.when(kind == "pytest", _pytest(lines)).when(kind == "cargo_test", _cargo_test(log)).when(kind == "pytest_states", _pytest_states(log))
    for name, pattern in DROPPED.items():
        stays = F.filter(lines, lambda x: ~x.rlike(pattern))  # noqa: B023  called here
        out = out.when(kind == name, F.transform(stays, lambda x: F.regexp_replace(x, GIT_HINT, "")) if name == "git" else stays)
    return F.array_join(out, "\n")


def prune(logs: DataFrame, most: int = MOST_CHARS, head: int = HEAD_CHARS, tail: int = TAIL_CHARS) -> DataFrame:
    """log_id, kind, filtered, guard, orig_tokens, new_tokens, saved_pct of logs (log_id, type_hint, exit_code, bypass, raw).

    guard: `bypass` (asked for), `error` (an error context was about to be lost), `empty` (nothing was left), or null.
    """
    rows = logs.select("log_id", "exit_code", F.coalesce("bypass", F.lit(False)).alias("bypass"), "type_hint", guard_length(F.coalesce("raw", F.lit("")), most, head, tail).alias("_raw"))
    rows = rows.withColumn("_clean", strip_ansi("_raw"))
    rows = rows.withColumn("kind", F.when(F.col("bypass"), "generic").otherwise(typed(F.col("_clean"), F.col("type_hint"))))
    bare = F.col("_clean").contains("Traceback (most recent call last):") & ~F.col("_clean").rlike(PYTEST_SECTION) & (F.col("kind") == "pytest")
    rows = rows.withColumn("kind", F.when(bare, "traceback").otherwise(F.col("kind")))
    rows = rows.withColumn("_kept", filtered(F.col("_clean"), F.col("kind")))
    met = rows.withColumn("_filtered", F.when(F.col("bypass"), F.col("_raw")).when(F.col("kind") == "traceback", trim_ws("_clean")).otherwise(F.coalesce("_kept", "_clean")))
    blank = trim_ws("_filtered") == ""
    lost = (F.coalesce("exit_code", F.lit(0)) != 0) & ((has_error(F.col("_clean")) & ~has_error(F.col("_filtered"))) | blank)
    guard = F.when(F.col("bypass"), "bypass").when(lost, "error").when(blank & (trim_ws("_clean") != ""), "empty")
    met = met.withColumn("guard", guard).withColumn("filtered", F.when(F.col("guard").isin("error", "empty"), trim_ws("_clean")).otherwise(F.col("_filtered")))
    met = met.withColumn("orig_tokens", est_chars4("_raw")).withColumn("new_tokens", est_chars4("filtered"))
    return met.select("log_id", "kind", "filtered", "guard", "orig_tokens", "new_tokens", F.round(saved_pct("orig_tokens", "new_tokens"), 6).alias("saved_pct"))
