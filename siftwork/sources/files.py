"""Sources: source trees, captured logs, configuration; sinks for the index."""

from __future__ import annotations

import atexit
import contextlib
import json
import tomllib
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LOCK_GLOBS, SECRET_GLOBS, in_skipped_folder, is_secret, is_source, language_of
from ..functions.scalars import short_hash


@dataclass(frozen=True)
class Config:
    """Settings, by the names that a settings file has (fixed values); list settings of a file are added to the defaults."""

    ignore_patterns: tuple[str, ...] = SECRET_GLOBS
    lockfile_patterns: tuple[str, ...] = LOCK_GLOBS
    lockfile_shield: bool = True
    max_cacheable_bytes: int = 5 * 1024 * 1024
    cache_ttl_days: int = 30
    max_cache_entries: int = 5000
    repo_map_budget: int = 1000
    max_source_files: int | None = 5000


def read_config(text: str, kind: str = "toml") -> Config:
    """A configuration of flat keys or of sections; unknown keys are passed over, a broken file gives the defaults."""
    try:
        data = tomllib.loads(text) if kind == "toml" else json.loads(text)
    except ValueError:
        return Config()
    flat = {}
    for key, value in data.items():
        flat |= value if isinstance(value, dict) else {key: value}
    known = {f.name for f in fields(Config)}
    changes = {k: v for k, v in flat.items() if k in known}
    for key in ("ignore_patterns", "lockfile_patterns"):
        if key in changes:
            changes[key] = tuple(dict.fromkeys([*getattr(Config(), key), *changes[key]]))
    return replace(Config(), **changes)


def decoded(content: str | Column) -> Column:
    """Text of bytes: UTF-8, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "utf-8")).otherwise(F.decode(c, "iso-8859-1"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """The rows of Spark's reader, and one for each empty file, which it passes over: no content, length 0, mtime null.

    Paths alone are compared for it; all are names that the reader's listing holds already. Names that begin with _ or .
    are hidden from Spark's readers, so they are not in it.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    jvm = spark._jvm
    names = DataFrame(spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(rows._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING()), spark)
    # listed names are encoded as addresses, paths are not
    path = F.regexp_replace(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    empty = names.select(path.alias("path")).join(rows.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")), "path", "left_anti")
    return rows.unionByName(empty.withColumns({"modificationTime": F.lit(None).cast("timestamp"), "length": F.lit(0).cast("long"), "content": F.lit(b"")}))


def list_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path, rel_path, length, mtime of all files below root (mtime is null for empty ones); contents are not read.

    hidden: names that begin with _ or . are listed, too, by the source of trees, which reads what pyarrow's file systems do.
    """
    if hidden:
        from .tree import list_tree

        return list_tree(spark, root).select("path", "rel_path", "length", "mtime")
    rel = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), r"\\", "/")
    return _files(spark, root).select("path", rel.alias("rel_path"), "length", F.col("modificationTime").alias("mtime"))


def _raw(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    if hidden:
        from .tree import list_tree

        return list_tree(spark, root).withColumnRenamed("rel_path", "file_path")
    return _files(spark, root).withColumn("file_path", F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)).withColumnRenamed("modificationTime", "mtime")


def _left_out(config: Config) -> Column:
    """Why a walk leaves a file out, by its path and length; null if it does not."""
    return (
        F.when(in_skipped_folder("file_path"), "FOLDER")
        .when(~is_source("file_path"), "NO_SOURCE")
        .when(is_secret("file_path", config.ignore_patterns), "SECRET")
        .when(F.col("length") > config.max_cacheable_bytes, "TOO_LARGE")
    )


def _first(good: DataFrame, most: int) -> DataFrame:
    """file_path, walk_ord of the first most files by path; only these are numbered in one place."""
    from pyspark.sql import Window

    return good.select("file_path").orderBy("file_path").limit(most).withColumn("walk_ord", F.row_number().over(Window.orderBy("file_path")))


def listed(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """file_path, length, mtime, status and walk_ord of all files below root; contents are not read.

    status: `read`, or why a walk leaves the file out: `FOLDER`, `NO_SOURCE`, `SECRET`, `TOO_LARGE`, `OVER_CAP`. walk_ord
    counts the files within the cap, max_source_files (None: no cap, and no count).
    """
    rows = _raw(spark, root).select("file_path", "length", "mtime", F.coalesce(_left_out(config), F.lit("read")).alias("status"))
    if config.max_source_files is None:
        return rows.withColumn("walk_ord", F.lit(None).cast("int"))
    rows = rows.join(F.broadcast(_first(rows.filter("status = 'read'"), config.max_source_files)), "file_path", "left")
    return rows.withColumn("status", F.when((F.col("status") == "read") & F.col("walk_ord").isNull(), "OVER_CAP").otherwise(F.col("status")))


def read_sources(spark: SparkSession, root: str, config: Config = Config(max_source_files=None), project: str | None = None, hidden: bool = False) -> DataFrame:
    """project_root, file_path, lang, mtime, length, text, file_hash, walk_ord of the sources that listed() says are read.

    There is no cap unless config sets one. Sizes are tested before contents are read; contents are not shuffled. hidden: as in list_files().
    """
    good = _raw(spark, root, hidden).filter(F.col("length") <= config.max_cacheable_bytes).filter(_left_out(config).isNull())
    if config.max_source_files is None:
        good = good.withColumn("walk_ord", F.lit(None).cast("int"))
    else:
        # the cap is over paths alone
        good = good.join(F.broadcast(_first(good, config.max_source_files)), "file_path")
    if hidden:
        from .tree import with_contents

        good = with_contents(good)
    text = decoded("content")
    return good.select(
        F.lit(project or root).alias("project_root"), "file_path", language_of("file_path").alias("lang"), "mtime", "length", text.alias("text"), short_hash(text).alias("file_hash"), "walk_ord"
    )


def read_logs(spark: SparkSession, path: str, type_hint: str = "auto", exit_code: int = 0) -> DataFrame:
    """Captured logs, a file each: log_id, type_hint, exit_code, bypass, raw."""
    rows = spark.read.text(path, wholetext=True).withColumn("log_id", F.col("_metadata.file_path"))
    return rows.select("log_id", F.lit(type_hint).alias("type_hint"), F.lit(exit_code).alias("exit_code"), F.lit(False).alias("bypass"), F.col("value").alias("raw"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log_id, chunk, pos, line of captured logs of any length: a file may be read by many tasks, a split each.

    chunk is the split's start in the file; pos grows within it. A newline at the end of a file ends its last line.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse, unless that is a local folder of a cluster's driver."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir")
        if place.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {place} is local")
    return place.rstrip("/") + "/siftwork"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which is deleted when the driver ends, or by clean()."""
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-core"
    if place not in _OWN:
        _OWN.add(place)
        atexit.register(_deleted, spark, place)
    return place


_OWN: set[str] = set()


def _deleted(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # at the end the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Deletes what this application's core operators and queries have written; call it when the results are used up."""
    _deleted(spark, own_folder(spark))


def written(table: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: what follows reads it instead of computing it anew, and no executor's loss costs it."""
    spark = table.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def write_savings(savings: DataFrame, path: str) -> None:
    """Adds savings (category, original, optimized) to the sink at path; a failed write leaves what was there."""
    savings.write.mode("append").parquet(path)


def write_projects(spark: SparkSession, roots: DataFrame, path: str) -> None:
    """Adds project roots to the sorted set of known ones: the whole set is written beside the old one, which is then no longer read."""
    known = read_projects(spark, path)
    version = 0 if known is None else known.agg(F.max("version")).first()[0] + 1
    every = roots.select("project_root") if known is None else known.select("project_root").unionByName(roots.select("project_root"))
    every.filter("project_root IS NOT NULL").distinct().sort("project_root").write.parquet(f"{path}/version={version}")


def read_projects(spark: SparkSession, path: str) -> DataFrame | None:
    """project_root, version of the last set written; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").select("project_root", "version")


def write_by_project(table: DataFrame, path: str) -> None:
    """Replaces the partitions of the projects in table, and no others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_root").parquet(path)
