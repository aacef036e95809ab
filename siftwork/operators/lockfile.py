"""Questions to lock files and generated assets: a package's entry, its context, or a summary. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..functions.scalars import est_chars4, trim_ws
from .text import lines_of, newline_count

#: Partial matches and blocks shown, dependencies in a summary, lines and characters around a match.
MATCHES, DEPENDENCIES, LINES_BEFORE, LINES_AFTER, CHARS_BEFORE, CHARS_AFTER = 3, 15, 3, 8, 100, 200
NPM = "struct<lockfileVersion:string,packages:map<string,string>,dependencies:map<string,string>>"
COMPOSER = "struct<packages:array<string>,`packages-dev`:array<string>>"
NAME_VERSION = r"name\s*=\s*[\"']([^\"']+)[\"']\s*\n\s*version\s*=\s*[\"']([^\"']+)[\"']"
NONE = "cast(array() as array<string>)"


def _first_hit(packages: Column, query: Column) -> Column:
    """The first of the exact keys that the map has."""
    q, low = query, F.lower(query)
    keys = F.array(F.concat(F.lit("node_modules/"), q), F.concat(F.lit("node_modules/"), low), q, low)
    return F.get(F.filter(keys, lambda k: F.map_contains_key(packages, k)), F.lit(0))


def _holding(keys: Column, query: Column, most: int) -> Column:
    return F.slice(F.filter(keys, lambda k: F.contains(F.lower(k), F.lower(query))), 1, most)


def _entries(map_: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit('{"'), k, F.lit('":'), map_[k], F.lit("}")))


def npm_matches(content: Column, query: Column) -> Column:
    """Entries as JSON texts: an exact key, else keys that hold the query, else the first such dependency."""
    data = F.from_json(content, NPM)
    packages, dependencies = data["packages"], data["dependencies"]
    hit = _first_hit(packages, query)
    partial = _holding(F.map_keys(packages), query, MATCHES)
    old = _holding(F.map_keys(dependencies), query, 1)
    return (
        F.when(hit.isNotNull(), _entries(packages, F.array(hit)))
        .when(F.size(partial) > 0, _entries(packages, partial))
        .when(F.size(old) > 0, _entries(dependencies, old))
        .otherwise(F.expr(NONE))
    )


def block_matches(content: Column, query: Column, most: int = MATCHES) -> Column:
    """[[package]] blocks whose name holds the query."""
    blocks = F.filter(F.transform(F.split(content, r"\r?\n(?=\[\[package\]\])", -1), trim_ws), lambda b: b.startswith("[[package]]"))
    named = F.filter(blocks, lambda b: F.contains(F.lower(F.regexp_extract(b, r"name\s*=\s*[\"']([^\"']+)[\"']", 1)), F.lower(query)))
    return F.slice(named, 1, most)


def yarn_matches(content: Column, query: Column) -> Column:
    """The first block whose heading holds the query."""
    blocks = F.filter(F.transform(F.split(content, r"\n[ \t]*\r?\n", -1), trim_ws), lambda b: b.contains("\n") & ~b.startswith("#"))
    return F.slice(F.filter(blocks, lambda b: F.contains(F.lower(F.substring_index(b, "\n", 1)), F.lower(query))), 1, 1)


def composer_matches(content: Column, query: Column) -> Column:
    """The first package, development packages last, whose name holds the query."""
    data = F.from_json(content, COMPOSER)
    none = F.expr(NONE)
    every = F.concat(F.coalesce(data["packages"], none), F.coalesce(data["packages-dev"], none))
    return F.slice(F.filter(every, lambda p: F.contains(F.lower(F.get_json_object(p, "$.name")), F.lower(query))), 1, 1)


def context(content: Column, query: Column, whole_lines: bool = False) -> Column:
    """struct<first, last, body>: lines around the first that holds the query; of one line, code points around it, or the line. Null if none."""
    lines = lines_of(content)
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lower(query))), F.lit(True)).cast("int")
    first, last = F.greatest(F.lit(1), at - LINES_BEFORE), F.least(F.size(lines), at + LINES_AFTER - 1)
    body = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    spot = F.position(F.lower(query), F.lower(content))
    start, end = F.greatest(F.lit(0), spot - 1 - CHARS_BEFORE), F.least(F.length(content), spot - 1 + CHARS_AFTER)
    by_lines = F.lit(True) if whole_lines else F.size(lines) > 1
    return F.when(by_lines & (at > 0), F.struct(first.alias("first"), last.alias("last"), body.alias("body"))).when(
        ~by_lines & (spot > 0), F.struct(start.alias("first"), end.alias("last"), F.substring(content, start + 1, end - start).alias("body"))
    )


def summary(name: Column, content: Column) -> Column:
    """struct<version, packages, direct, sample>: what a lock file holds; nulls where it does not say."""
    data = F.from_json(content, NPM)
    packages, dependencies = data["packages"], data["dependencies"]
    root = F.from_json(F.get_json_object(packages[""], "$.dependencies"), "map<string,string>")
    direct = F.coalesce(root, dependencies)
    version = lambda v: F.coalesce(F.get_json_object(v, "$.version"), v)
    listed = F.transform(F.slice(F.map_keys(direct), 1, DEPENDENCIES), lambda k: F.concat(k, F.lit("@"), version(direct[k])))
    names, versions = F.regexp_extract_all(content, F.lit(NAME_VERSION), F.lit(1)), F.regexp_extract_all(content, F.lit(NAME_VERSION), F.lit(2))
    blocks = F.slice(F.zip_with(names, versions, lambda n, v: F.concat(n, F.lit("@"), v)), 1, DEPENDENCIES)
    npm, block = name.rlike("package-lock.json|shrinkwrap"), name.rlike("cargo.lock|poetry.lock")
    return F.struct(
        F.when(npm, data["lockfileVersion"]).alias("version"),
        F.when(npm, F.coalesce(F.size(packages), F.size(dependencies))).when(block, F.size(names)).alias("packages"),
        F.when(npm, F.size(direct)).alias("direct"),
        F.when(npm, listed).when(block, blocks).alias("sample"),
        newline_count(content).alias("lines"),
        F.length(content).alias("chars"),
    )


def ask(lockfiles: DataFrame, whole_lines: bool = False) -> DataFrame:
    """lockfiles (file_name, content, query; other columns stay) with status, how, matches, context, summary, orig_tokens, opt_tokens.

    status: `found` (how: entry or context), `not_found`, or `summary` where no query is asked. whole_lines: the context
    of a content of one line is that line, not the characters around the query.
    """
    name = F.lower(base_name("file_name"))
    rows = lockfiles.withColumn("_name", name).withColumn("_query", trim_ws(F.coalesce("query", F.lit(""))))
    c, q = F.col("content"), F.col("_query")
    matches = (
        F.when(F.col("_name").rlike("package-lock.json|shrinkwrap"), npm_matches(c, q))
        .when(F.col("_name").rlike("cargo.lock|poetry.lock"), block_matches(c, q))
        .when(F.col("_name").contains("yarn.lock"), yarn_matches(c, q))
        .when(F.col("_name").contains("composer.lock"), composer_matches(c, q))
    )
    asked = q != ""
    rows = rows.withColumn("matches", F.when(asked, F.coalesce(matches, F.expr(NONE))))
    rows = rows.withColumn("context", F.when(asked & (F.size("matches") == 0), context(c, q, whole_lines)))
    rows = rows.withColumn("how", F.when(F.size("matches") > 0, "entry").when(F.col("context").isNotNull(), "context"))
    rows = rows.withColumn("status", F.when(~asked, "summary").when(F.col("how").isNotNull(), "found").otherwise("not_found"))
    rows = rows.withColumn("summary", F.when(~asked, summary(F.col("_name"), c)))
    shown = F.coalesce(F.when(F.size("matches") > 0, F.array_join("matches", "\n\n")), F.col("context.body"), F.to_json("summary"), F.lit(""))
    return rows.withColumn("orig_tokens", est_chars4(c)).withColumn("opt_tokens", est_chars4(shown)).drop("_name", "_query")
