"""Text operators over whole texts: lines, slices, pages, fallbacks. All are narrow: none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, est_chars4, gather, gathered, gathering

#: The most lines and characters of a page, and the lines that a fallback shows after its first.
PAGE_LINES, PAGE_CHARS, FALLBACK_LINES = 40, 2500, 40

estimate_tokens = est_chars4


def lines_of(text: str | Column) -> Column:
    """The lines, split at LF or CRLF; no empty line after a final line end."""
    parts = F.split(col(text), "\r?\n", -1)
    return F.when(col(text) == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """key, others, line_no (from 1), line."""
    return docs.select(key, *others, F.posexplode(lines_of(text)).alias("_pos", "line")).select(key, *others, (F.col("_pos") + 1).alias("line_no"), "line")


def line_count(text: str | Column) -> Column:
    return F.size(lines_of(text))


def newline_count(text: str | Column) -> Column:
    """Line ends and one more."""
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit("\n"), F.lit(""))) + 1


def slice_bounds(total: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Status, first and last line of a slice: missing bounds are the file's, others are clamped to it."""
    first = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    last = F.least(total, F.coalesce(end, total))
    status = F.when(total == 0, "EMPTY").when(first > total, "START_BEYOND_END").when(first > last, "INVALID_RANGE").otherwise("OK")
    return status, first, last


def numbered(lines: Column, first: Column) -> Column:
    """The lines as `n: line`."""
    return F.transform(lines, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x))


def page_length(lines: Column, most_lines: int = PAGE_LINES, most_chars: int = PAGE_CHARS) -> Column:
    """How many lines the first page takes: at least one, then as long as the characters (and a line end each) fit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def step(acc, x):
        takes = acc["open"] & ((acc["n"] == 0) | (acc["chars"] + F.length(x) <= most_chars))
        return F.struct(
            (acc["n"] + takes.cast("int")).alias("n"),
            F.when(takes, acc["chars"] + F.length(x) + 1).otherwise(acc["chars"]).alias("chars"),
            takes.alias("open"),
        )

    return F.aggregate(F.slice(lines, 1, most_lines), start, step, lambda acc: acc["n"])


def next_page(last: Column, end: Column, most_lines: int = PAGE_LINES) -> tuple[Column, Column]:
    """First and last line to ask for after a page that ends at last, in a slice that ends at end; null at the end."""
    more = last < end
    return F.when(more, last + 1), F.when(more, F.least(last + most_lines, end))


def page_starts(lines: Column, most_lines: int = PAGE_LINES, most_chars: int = PAGE_CHARS) -> Column:
    """The first line of every page, in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("at"), *(x.alias(n) for n, x in gathering("int").items()))

    def step(acc, x):
        fits = (acc["n"] > 0) & (acc["n"] < most_lines) & (acc["chars"] + F.length(x) <= most_chars)
        return F.struct(
            F.when(fits, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(fits, acc["chars"] + F.length(x) + 1).otherwise(F.length(x) + 1).alias("chars"),
            (acc["at"] + 1).alias("at"),
            *gather(acc, acc["at"] + 1, ~fits),
        )

    return F.aggregate(lines, start, step, gathered)


def first_page(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, total_lines, page_end, next_start, next_end, shown_chars, orig_tokens, opt_tokens of each text's first page."""
    rows = docs.select(key, F.col(text).alias("_text"), lines_of(text).alias("_lines"))
    rows = rows.withColumn("total_lines", F.size("_lines")).withColumn("page_end", page_length(F.col("_lines")))
    start, end = next_page(F.col("page_end"), F.col("total_lines"))
    shown = F.array_join(numbered(F.slice(F.col("_lines"), F.lit(1), F.col("page_end")), F.lit(1)), "\n")
    rows = rows.withColumn("next_start", start).withColumn("next_end", end).withColumn("_shown", shown)
    return rows.select(key, "total_lines", "page_end", "next_start", "next_end", F.length("_shown").alias("shown_chars"), est_chars4("_text").alias("orig_tokens"), est_chars4("_shown").alias("opt_tokens"))


def slice_lines(docs: DataFrame, start: Column, end: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, status, total_lines, first, last, page_end, next_start, next_end, body: the first page of a numbered slice."""
    rows = docs.select("*", lines_of(text).alias("_lines"))
    status, first, last = slice_bounds(F.size("_lines"), start, end)
    rows = rows.withColumn("status", status).withColumn("first", first).withColumn("last", last)
    part = F.when(F.col("status") == "OK", numbered(F.slice("_lines", F.col("first"), F.col("last") - F.col("first") + 1), F.col("first")))
    rows = rows.withColumn("_part", part).withColumn("page_end", F.col("first") + page_length(F.col("_part")) - 1)
    after, until = next_page(F.col("page_end"), F.col("last"))
    body = F.array_join(F.slice("_part", F.lit(1), F.col("page_end") - F.col("first") + 1), "\n")
    return rows.select(key, "status", F.size("_lines").alias("total_lines"), "first", "last", "page_end", after.alias("next_start"), until.alias("next_end"), body.alias("body"))


def symbol_fallback(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, match_line, end_line, body: from the first line that holds needle, FALLBACK_LINES more; only texts that hold it."""
    rows = docs.filter(F.col(text).contains(needle)).select(key, lines_of(text).alias("_lines"))
    rows = rows.withColumn("match_line", F.array_position(F.transform("_lines", lambda x: x.contains(needle)), F.lit(True)).cast("int")).filter("match_line > 0")
    rows = rows.withColumn("end_line", F.least(F.size("_lines"), F.col("match_line") + FALLBACK_LINES))
    body = F.array_join(numbered(F.slice("_lines", F.col("match_line"), F.col("end_line") - F.col("match_line") + 1), F.col("match_line")), "\n")
    return rows.select(key, "match_line", "end_line", body.alias("body"))
