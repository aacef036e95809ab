"""Symbol search over tables of symbols (name, file_path, line, ...) and of their occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import like_contains, similarity

#: Results, the least similarity, definitions and references that are shown, suggestions.
RESULTS, LEAST_SIMILARITY, DEFINITIONS, REFERENCES, SUGGESTIONS = 15, 0.5, 10, 25, 3


def exact(symbols: DataFrame, name: str, most: int = RESULTS) -> DataFrame:
    return symbols.filter(F.col("name") == name).orderBy("file_path", "line", "name").limit(most)


def like(symbols: DataFrame, needle: str, most: int | None = RESULTS) -> DataFrame:
    """The first most symbols whose name holds needle; None: all, in no order."""
    found = symbols.filter(like_contains("name", needle))
    return found if most is None else found.orderBy("file_path", "line", "name").limit(most)


def fuzzy(symbols: DataFrame, query: str, most: int = RESULTS) -> DataFrame:
    """The most similar symbols, best first, each place once. Similarity is computed once a distinct name."""
    names = symbols.select("name").distinct().withColumn("score", F.round(similarity(F.lit(query), F.col("name")), 6)).filter(F.col("score") >= LEAST_SIMILARITY)
    hits = symbols.join(names, "name").dropDuplicates(["file_path", "name", "line"])
    return hits.orderBy(F.desc("score"), "file_path", "line", "name").limit(most)


def search(symbols: DataFrame, query: str, exact_only: bool = False, most: int = RESULTS) -> DataFrame:
    """Matches by name, with match `exact` or `like`; only if there are none, similar names with match `fuzzy`."""
    query = query.strip()
    found = (exact if exact_only else like)(symbols, query, most) if query else symbols.limit(0)
    found = found.withColumn("score", F.lit(1.0)).withColumn("match", F.lit("exact" if exact_only else "like"))
    if not query or not found.isEmpty():
        return found
    return fuzzy(symbols, query, most).withColumn("match", F.lit("fuzzy")).select(found.columns)


def suggest(symbols: DataFrame, query: str, least: float = 0.4, most: int = SUGGESTIONS) -> DataFrame:
    """The most similar distinct names of each file: file_path, name, score, place."""
    from pyspark.sql import Window

    scored = symbols.groupBy("file_path", "name").agg(F.round(F.max(similarity(F.lit(query), F.col("name"))), 6).alias("score")).filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "name"))
    return scored.withColumn("place", place).filter(F.col("place") <= most)


def references(occurrences: DataFrame, symbols: DataFrame, name: str, definitions: int = DEFINITIONS) -> DataFrame:
    """Occurrences (file_path, line, ord, name, kind, snippet, is_def) of name, the first of a line, but where it is defined."""
    from pyspark.sql import Window

    defined = symbols.filter(F.col("name") == name).orderBy("file_path", "line").limit(definitions).select("file_path", "line")
    rows = occurrences.filter((F.col("name") == name) & ~F.col("is_def")).join(F.broadcast(defined), ["file_path", "line"], "left_anti")
    first = F.row_number().over(Window.partitionBy("file_path", "line").orderBy("ord"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def blast_radius(occurrences: DataFrame, symbols: DataFrame, name: str, most: int = REFERENCES) -> DataFrame:
    """The first references in path order, with the totals of references and files beside each."""
    refs = references(occurrences, symbols, name)
    totals = refs.agg(F.count(F.lit(1)).alias("total_refs"), F.count_distinct("file_path").alias("total_files"))
    # one row of totals
    return refs.orderBy("file_path", "line").limit(most).crossJoin(F.broadcast(totals))


def word_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """file_path, line, snippet and words (ord, name, kind): every identifier-like run of each line, without a parser, and others of docs; comment lines are passed over.

    A row a line, so that a long line's text is not repeated for each of its words.
    """
    from .text import explode_lines

    rows = explode_lines(docs, key, text, *others).withColumn("snippet", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    rows = rows.filter(~F.col("snippet").rlike(r"^(#|//|/\*|\*)"))
    # what a line tells of all its words is found once a line: whether it imports, and the runs that a bracket follows, of which a called name is the end
    told = F.struct(
        F.col("snippet").rlike(r"import |from |require\(|use ").alias("imports"),
        F.array_distinct(F.regexp_extract_all("snippet", F.lit(r"(?U)(?<!\w)(\w++)\("), F.lit(1))).alias("called"),
        F.regexp_extract_all("line", F.lit(r"(?U)\w+"), F.lit(0)).alias("names"),
    )
    kind = lambda t, name: F.when(t["imports"], "IMPORT").when(F.exists(t["called"], lambda c: c.endswith(name)), "CALL").otherwise("USAGE")
    words = lambda t: F.transform(t["names"], lambda x, i: F.struct(i.alias("ord"), x.alias("name"), kind(t, x).alias("kind")))
    # an array of one, so that Spark does not put the line's patterns into what is done for a word
    return rows.select(*others, F.col(key).alias("file_path"), F.col("line_no").alias("line"), "snippet", F.get(F.transform(F.array(told), words), F.lit(0)).alias("words"))


def words_as_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fallback without a parser: the words of word_lines(), a row each."""
    rows = word_lines(docs, key, text).select("file_path", "line", "snippet", F.inline("words"))
    return rows.select("file_path", "line", "ord", "name", "kind", "snippet", F.lit(False).alias("is_def"))
