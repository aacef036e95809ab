"""A data source of source trees that hides no names, with folders as partitions and filters pushed down, and a committed sink of parts.

Spark's file readers pass over names that begin with `_` or `.`, which in source trees are sources (`__init__.py`). This
source lists folders itself, by pyarrow's file systems (local, HDFS, object stores: those that pyarrow reads by address).
The driver lists folders breadth first until there are SPLIT of them or none is left; each is a partition that a task
walks to its end, so a deep tree is walked in parallel and the driver holds SPLIT folders at most, besides the files beside
them. Filters on path, rel_path and length are tested before a file is opened.

The sink writes each task's rows to a staged file; only when all tasks are done does the commit move the files to their
place, and an abort deletes them. So a failed write leaves no rows, and a task's repeated attempt leaves its last file only.

Defined results: an empty folder has no rows; an empty file has a row; links are followed as the file system does; a file
that vanishes between listing and reading fails the read; contents are null unless asked for by the option contents.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

# a source is planned in a worker on the driver that does not get the package: so it is sent by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 256
SCHEMA = "path string, rel_path string, length long, mtime timestamp, content binary"
#: Rows that a task holds at once.
BATCH_FILES = 64


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class Folders(InputPartition):
    def __init__(self, folders: list[str], files: list[tuple]):
        self.folders, self.files = folders, files


class Tests:
    """Filters that are told by a file's names and length."""

    SAYS = {
        EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
        StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    }

    def __init__(self):
        self.taken: list[tuple] = []

    def take(self, f: Filter) -> bool:
        if type(f) in self.SAYS and f.attribute in (("path",), ("rel_path",), ("length",)):
            self.taken.append((type(f), f.attribute[0], f.value))
            return True
        return False

    def hold(self, path: str, rel: str, length: int) -> bool:
        row = {"path": path, "rel_path": rel, "length": length}
        return all(self.SAYS[kind](row[name], value) for kind, name, value in self.taken)


class TreeReader(DataSourceReader):
    def __init__(self, path: str, contents: bool, split: int):
        self.path, self.contents, self.split = path.rstrip("/"), contents, split
        self.tests = Tests()

    def pushFilters(self, filters: list[Filter]):
        yield from (f for f in filters if not self.tests.take(f))

    def _list(self, fs, folder: str, recursive: bool):
        from pyarrow.fs import FileSelector, FileType

        folders, files = [], []
        for f in fs.get_file_info(FileSelector(folder, recursive=recursive)):
            if f.type == FileType.Directory:
                folders.append(f.path)
            else:
                files.append((f.path, f.size, f.mtime))
        return folders, files

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.path)
        root = root.rstrip("/")
        open_, files, split = [root], [], False
        # breadth first: a level's folders take the place of their parents, until there are enough
        while open_ and not split:
            level = open_
            open_ = []
            for k, folder in enumerate(level):
                inside, beside = self._list(fs, folder, False)
                open_ += inside
                files += beside
                if len(open_) + len(level) - k - 1 >= self.split:
                    open_ += level[k + 1 :]
                    split = True
                    break
        parts = [Folders([folder], []) for folder in open_]
        return parts + [Folders([], files[i : i + 1000]) for i in range(0, len(files), 1000)] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa

        fs, root = _opened(self.path)
        root = root.rstrip("/")
        head = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        names = ["path", "rel_path", "length", "mtime", "content"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]

        def rows():
            todo, files = list(partition.folders), list(partition.files)
            while todo or files:
                for path, size, mtime in files:
                    rel, full = path[len(root) + 1 :], head + path
                    if self.tests.hold(full, rel, size):
                        content = fs.open_input_stream(path).read() if self.contents else None
                        yield full, rel, size, mtime, content
                files = []
                if todo:
                    inside, files = self._list(fs, todo.pop(), False)
                    todo += inside

        batch = []
        for row in rows():
            batch.append(row)
            if len(batch) >= BATCH_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batch), kinds)], names)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batch), kinds)], names)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    """Parquet parts, staged by tasks and moved by the commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/.staged-{self.job}", recursive=True)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(fs.open_output_stream(f"{root}/.staged-{self.job}/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Staged("", 0)
        out.close()
        return Staged(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{root}/.staged-{self.job}/{m.file}", f"{root}/{m.file}")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = _opened(self.path)
        staged = f"{root}/.staged-{self.job}"
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("contents", True).load(root); df.write.format("source_tree").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], str(self.options.get("contents", "false")).lower() == "true", int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PartsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; filters are pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def list_tree(spark: SparkSession, root: str, contents: bool = False, split: int = SPLIT) -> DataFrame:
    """path, rel_path, length, mtime, content of all files below root, hidden names included."""
    register(spark)
    return spark.read.format("source_tree").option("contents", contents).option("split", split).load(root)


def with_contents(rows: DataFrame) -> DataFrame:
    """rows with content, the bytes of the file at path: what has been filtered before is not opened."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType

    rows = rows.drop("content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, BATCH_FILES):
                part = b.slice(i, BATCH_FILES)
                found = [fs.open_input_stream(at).read() for fs, at in map(_opened, part.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "content"])

    return rows.mapInArrow(run, rows.withColumn("content", F.lit(None).cast(BinaryType())).schema)
