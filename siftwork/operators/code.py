"""Code-structure operators: texts are parsed once, in Arrow batches, and only the extracted rows leave the workers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions import parsing
from ..functions.scalars import est_chars4, saved_pct
from ..shipping import bounded_batches

SYMBOLS = "file_path string, ord int, name string, kind string, line int, end_line int, signature string, full_signature string, depth int, parent_ord int, ext boolean, content_hash string"
OCCURRENCES = "file_path string, ord int, name string, line int, kind string, snippet string, is_def boolean"


def _spread(files: DataFrame) -> DataFrame:
    """The files dealt to as many tasks as a shuffle has: parsing costs far more than reading, and a table that is small on disk is read by a few tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rows(files: DataFrame, of, schema: str) -> DataFrame:
    """of(text, lang) -> tuples, each given its file_path in front."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *row) for p, t, lang in zip(pdf["file_path"], pdf["text"], pdf["lang"]) for row in of(t or "", lang)], columns=names)

    bounded_batches(files.sparkSession)
    return _spread(files.select("file_path", "text", "lang")).mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """All definitions of files (file_path, text, lang)."""
    return _rows(files, parsing.symbols, SYMBOLS)


def occurrences(files: DataFrame, needle: str | None = None) -> DataFrame:
    """All identifiers of files; with needle, only files that hold it are parsed and only it is returned."""
    if needle is not None:
        files = files.filter(F.col("text").contains(needle))
    rows = _rows(files, parsing.occurrences, OCCURRENCES)
    return rows if needle is None else rows.filter(F.col("name") == needle)


def with_imports(files: DataFrame) -> DataFrame:
    @F.pandas_udf(IntegerType())
    def count(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([parsing.imports(t or "", g) for t, g in zip(text, lang)], dtype="int32")

    bounded_batches(files.sparkSession)
    return files.withColumn("n_imports", count("text", "lang"))


def skeletons(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """file_path, status (`ok` or `unsupported`, then the text as it is), skeleton, orig_tokens, opt_tokens, saved_pct, and the columns of files to keep."""

    @F.pandas_udf(StringType())
    def build(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([parsing.skeleton(t or "", g) for t, g in zip(text, lang)], dtype=object)

    bounded_batches(files.sparkSession)
    rows = _spread(files.select("file_path", *keep, "text", "lang")).select("file_path", *keep, "text", build("text", "lang").alias("_skeleton"))
    rows = rows.select("file_path", *keep, F.when(F.col("_skeleton").isNull(), "unsupported").otherwise("ok").alias("status"), F.coalesce("_skeleton", "text").alias("skeleton"), est_chars4("text").alias("orig_tokens"))
    return rows.withColumn("opt_tokens", est_chars4("skeleton")).withColumn("saved_pct", F.round(saved_pct("orig_tokens", "opt_tokens"), 6))


def symbol_ranges(files: DataFrame, name: str) -> DataFrame:
    """file_path, line, end_line, kind, implementation of each file's first definition of name."""
    from .text import lines_of

    found = symbols(files.filter(F.col("text").contains(name))).filter(F.col("name") == name)
    first = found.groupBy("file_path").agg(F.min_by(F.struct("line", "end_line", "kind"), "ord").alias("_d")).select("file_path", "_d.*")
    # texts may be far larger than Spark expects of columns that are made, so neither side is broadcast
    met = files.select("file_path", "text").join(first.hint("merge"), "file_path")
    body = F.array_join(F.slice(lines_of("text"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    return met.select("file_path", "line", "end_line", "kind", body.alias("implementation"))


def get_symbol(files: DataFrame, name: str) -> DataFrame:
    """file_path, status (`found` or `missing`), line, end_line, kind, implementation, suggestions (similar names, best first)."""
    from .search import suggest

    near = suggest(symbols(files), name).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("_near"))
    rows = files.select("file_path").join(symbol_ranges(files, name).hint("merge"), "file_path", "left").join(near.hint("merge"), "file_path", "left")
    missing = F.col("line").isNull()
    return rows.withColumn("status", F.when(missing, "missing").otherwise("found")).withColumn("suggestions", F.when(missing, F.coalesce("_near", F.expr("cast(array() as array<string>)")))).drop("_near")
