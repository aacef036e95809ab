"""One read of a file: guards, slices, symbols, lock files and repeated reads composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_binary, is_lock_file, is_secret, language_of
from ..functions.scalars import est_chars4, trim_ws
from ..sources.files import Config
from . import code, lockfile, reads
from .text import first_page, lines_of, next_page, numbered, page_length, slice_bounds


def guarded(requests: DataFrame, files: DataFrame, config: Config = Config()) -> DataFrame:
    """requests (request_id, file_path, force_full, query, start_line, end_line, symbol) with text and status.

    The first that holds: MISSING, DIRECTORY, TOO_LARGE, SECRET, BINARY; else the branch that answers: SYMBOL, SLICE,
    FULL, LOCKFILE or CACHED. Force passes over the guards of size, secrets and binaries. files: file_path, length,
    text, is_dir.
    """
    met = requests.join(files.select("file_path", "length", "text", "is_dir"), "file_path", "left")
    free = ~F.coalesce("force_full", F.lit(False))
    status = (
        F.when(F.col("length").isNull() & ~F.coalesce("is_dir", F.lit(False)), "MISSING")
        .when(F.col("is_dir"), "DIRECTORY")
        .when(free & (F.col("length") > config.max_cacheable_bytes), "TOO_LARGE")
        .when(free & is_secret("file_path", config.ignore_patterns), "SECRET")
        .when(free & is_binary("file_path"), "BINARY")
        .when(trim_ws(F.coalesce("symbol", F.lit(""))) != "", "SYMBOL")
        .when(F.col("start_line").isNotNull() | F.col("end_line").isNotNull(), "SLICE")
        .when(~free, "FULL")
        .when(F.lit(config.lockfile_shield) & is_lock_file("file_path", config.lockfile_patterns), "LOCKFILE")
        .otherwise("CACHED")
    )
    return met.withColumn("status", status)


def answer(requests: DataFrame, files: DataFrame, config: Config = Config()) -> DataFrame:
    """request_id, status, detail, first, last, next_start, next_end, body, orig_tokens, opt_tokens of each request."""
    rows = guarded(requests, files, config)
    out = ("request_id", "status", "detail", "first", "last", "next_start", "next_end", "body", "orig_tokens", "opt_tokens")
    null = lambda kind: F.lit(None).cast(kind)

    def shaped(t: DataFrame) -> DataFrame:
        kinds = dict(zip(out, ("", "", "string", "int", "int", "int", "int", "string", "bigint", "bigint")))
        for c, k in kinds.items():
            if c not in t.columns:
                t = t.withColumn(c, null(k))
        t = t.withColumn("orig_tokens", F.coalesce(est_chars4("text"), F.lit(0))).withColumn("opt_tokens", F.coalesce(est_chars4("body"), F.lit(0)))
        return t.select(*(F.col(c).cast(kinds[c]) if kinds[c] else F.col(c) for c in out))

    refused = rows.filter(F.col("status").isin("MISSING", "DIRECTORY", "TOO_LARGE", "SECRET", "BINARY"))
    full = rows.filter("status = 'FULL'").withColumn("body", F.col("text"))

    # slices: bounds, then the first page of the numbered lines
    cut = rows.filter("status = 'SLICE'").withColumn("_lines", lines_of("text"))
    told, first, last = slice_bounds(F.size("_lines"), F.col("start_line"), F.col("end_line"))
    cut = cut.withColumn("detail", told).withColumn("first", first).withColumn("_end", last)
    paged = _page(cut)

    # symbols: the definition, else the first line that holds the name
    asked = rows.filter("status = 'SYMBOL'").withColumn("symbol", trim_ws("symbol")).withColumn("_lines", lines_of("text"))
    defined = code.symbols(asked.select("file_path", "text", language_of("file_path").alias("lang")).dropDuplicates(["file_path"]))
    defined = defined.groupBy("file_path", F.col("name").alias("symbol")).agg(F.min_by(F.struct("line", "end_line"), "ord").alias("_d"))
    asked = asked.join(defined, ["file_path", "symbol"], "left")
    at = F.array_position(F.transform("_lines", lambda x: F.contains(x, F.col("symbol"))), F.lit(True)).cast("int")
    asked = asked.withColumn("_at", F.coalesce(F.col("_d.line"), F.when(at > 0, at)))
    asked = asked.withColumn("detail", F.when(F.col("_d").isNotNull(), "OK").when(F.col("_at").isNotNull(), "BY_TEXT").otherwise("NOT_FOUND"))
    asked = asked.withColumn("first", F.col("_at")).withColumn("_end", F.coalesce(F.col("_d.end_line"), F.least(F.size("_lines"), F.col("_at") + 40)))
    symbol = _page(asked)

    locks = lockfile.ask(rows.filter("status = 'LOCKFILE'").select("request_id", "text", F.col("status").alias("_status"), F.col("file_path").alias("file_name"), F.col("text").alias("content"), "query"))
    body = F.coalesce(F.when(F.size("matches") > 0, F.array_join("matches", "\n\n")), F.col("context.body"), F.to_json("summary"))
    locks = locks.withColumn("detail", F.col("status")).withColumn("status", F.col("_status")).withColumn("body", body).drop("orig_tokens", "opt_tokens")

    # repeated reads in order of the requests
    cached = reads.read_results(rows.filter("status = 'CACHED'").select("request_id", "status", "file_path", "text").withColumnsRenamed({"status": "_branch", "text": "content"}), "file_path", "request_id")
    cached = cached.withColumnsRenamed({"status": "detail", "_branch": "status", "text": "_shown", "content": "text"})
    pages = first_page(cached.filter(F.col("detail") == reads.FIRST), "request_id").select("request_id", "page_end", "next_start", "next_end")
    cached = cached.join(pages, "request_id", "left").withColumn("_lines", lines_of("text"))
    page = F.array_join(numbered(F.slice("_lines", F.lit(1), F.greatest(F.col("page_end"), F.lit(0))), F.lit(1)), "\n")
    cached = cached.withColumn("body", F.when(F.col("next_start").isNotNull(), page).otherwise(F.col("_shown"))).withColumn("first", F.when(F.col("page_end").isNotNull(), 1)).withColumn("last", F.col("page_end")).drop("orig_tokens", "opt_tokens")

    parts = [shaped(t) for t in (refused, full, paged, symbol, locks, cached)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _page(rows: DataFrame) -> DataFrame:
    """rows (_lines, first, _end, detail) with last, next_start, next_end and body: the first page of the numbered slice."""
    good = F.col("detail").isin("OK", "BY_TEXT")
    part = F.when(good, numbered(F.slice("_lines", F.col("first"), F.greatest(F.col("_end") - F.col("first") + 1, F.lit(0))), F.col("first")))
    rows = rows.withColumn("_part", part).withColumn("last", F.col("first") + page_length(F.col("_part")) - 1)
    after, until = next_page(F.col("last"), F.col("_end"))
    body = F.array_join(F.slice("_part", F.lit(1), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
    return rows.withColumn("next_start", after).withColumn("next_end", until).withColumn("body", body)
