"""Streams that keep stored tables: a continuous index of names, and sums of savings; each batch is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.savings import valid
from ..operators.search import word_lines
from ..operators.store import BUCKET, GATHERED, Store

WORDS = ArrayType(StructType().add("ord", "integer").add("name", "string").add("kind", "string"))
#: What is stored: a row a line, whose text is not repeated for each of its words.
INDEX = StructType().add("file_path", "string").add("line", "integer").add("snippet", "string").add("words", WORDS)
SUMS = StructType().add("category", "string").add("original", "long").add("optimized", "long").add("saved", "long").add("count", "long")


class Index(Store):
    """The stored lines of an index; they are read and looked up as occurrences: file_path, line, ord, name, kind, snippet."""

    def _occurrences(self, lines: DataFrame) -> DataFrame:
        return lines.select("file_path", "line", "snippet", F.inline("words")).select("file_path", "line", "ord", "name", "kind", "snippet")

    def read(self, version: int | None = None) -> DataFrame:
        return self._occurrences(super().read(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        return self._occurrences(super().lookup(keys))


def _lines(occurrences: DataFrame) -> DataFrame:
    """Occurrences as the rows that are stored."""
    words = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "name", "kind")))
    return occurrences.groupBy("file_path", "line", "snippet").agg(words.alias("words"))


def keep_indexed(files: DataFrame, path: str, state: str, parse=None, gathered: int = GATHERED, trigger: dict | None = None) -> Index:
    """The store at path of the occurrences in a stream of files (file_path, text), of each file's last text.

    parse: gives the occurrences of files by their columns of path and text; without it, every word is one.

    Each micro-batch replaces the occurrences of its files; a file that comes with a null text has none from then on. Of a
    batch, the text that is the greatest wins if a file comes twice. A batch that is repeated after a failure is not
    applied again. Buckets are compacted as they gather sets. Runs until the stream is taken (trigger: availableNow unless given).
    """
    store = Index(files.sparkSession, path, INDEX, ["file_path"])

    def take(batch: DataFrame, number: int) -> None:
        if parse is None:  # texts move once, to where their lines are written, as lines with their words are far larger
            rows = store.dealt(batch.select("file_path", "text")).groupBy(BUCKET, "file_path").agg(F.max("text").alias("text"))
            found = word_lines(rows.filter("text IS NOT NULL"), "file_path", "text", BUCKET)
        else:
            rows = batch.groupBy("file_path").agg(F.max("text").alias("text"))
            found = _lines(parse(rows.filter("text IS NOT NULL"), "file_path", "text"))
        store.replace(found, "files", number, emptied=rows)
        store.compact(gathered)

    run = files.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()
    run.awaitTermination()
    return store


def keep_savings(savings: DataFrame, path: str, state: str, trigger: dict | None = None) -> Store:
    """The store at path of sums by category of a stream of savings: exactly once, however often a batch is repeated.

    A batch's sums are added to those of the last version in one publication; if another writer has published in between,
    they are added to its sums.
    """
    store = Store(savings.sparkSession, path, SUMS, ["category"], 1)
    numbers = [n for n in SUMS.names if n != "category"]

    def take(batch: DataFrame, number: int) -> None:
        sums = valid(batch).groupBy("category").agg(F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("count"))
        store.add_up(sums, numbers, "savings", number)

    savings.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return store
