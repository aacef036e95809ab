"""A keyed table that changes without being rewritten: deltas and tombstones by buckets of the key, compacted where they gather.

A table is a folder. Each write adds a set of Parquet files, partitioned by bucket, of only the rows that it changes; a
version file lists the sets that count, oldest first, and the buckets each still counts for. Of a key, the rows of the
last set that has it are its rows (one or many), and a tombstone says that it has none. Reading merges only the buckets
that have more than one set; compact() rewrites only buckets that have gathered many. A version is published by renaming a
written file to its number, which fails if another writer was first: then the versions are read again and the change is
made to the new one, so writers need no lock. Files that no version names are left by writers that failed, and are never
read. Publishing relies on a file system whose rename is atomic and does not overwrite, as that of HDFS; writers in one
process are kept apart by a lock, so a local file system serves them, too.

Writes may carry the name of a stream and a batch's number: a batch that a version has applied is not applied again, so
a stream's restart, which repeats its last batch, changes nothing.

Defined results: keys may be null, which is a key like any other; rows of one write with one key are all its rows; a key
that is both deleted and written in later sets is what the last one says; an empty write publishes nothing but its batch's
number; a table of no sets is empty, with its schema.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32
#: Tasks a bucket that buckets are dealt to by hash, so that few have two.
SPREAD = 8
#: Sets of a bucket from which compact() rewrites it.
GATHERED = 4
GONE, BUCKET, ORDER = "_gone", "_bucket", "_order"
_PUBLISHING = threading.Lock()


#: Of sessions whose writers are side by side now: how many writes, and the setting before.
_WRITING: dict[int, list] = {}
_SETTING = threading.Lock()


@contextlib.contextmanager
def _side_by_side(spark: SparkSession, files: int):
    """A task writes up to so many files at once, without sorting its rows by them; the setting goes back when the session's last such write ends."""
    conf, key = spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    with _SETTING:
        now = _WRITING.setdefault(id(spark), [0, conf.get(key)])
        now[0] += 1
        conf.set(key, str(max(files, int(conf.get(key)))))
    try:
        yield
    finally:
        with _SETTING:
            now[0] -= 1
            if not now[0]:
                conf.set(key, _WRITING.pop(id(spark))[1])


class Conflict(Exception):
    """Another writer has published this version."""


class Store:
    """A table at path; keys: its key columns."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The last version's number; 0 before the first write."""
        folder = self._at("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """sets: [name, buckets] that count, oldest first; batches: the last one applied, by stream."""
        version = self.version() if version is None else version
        if not version:
            return {"sets": [], "batches": {}}
        stream = self._fs.open(self._at("versions", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, version: int, content: dict) -> None:
        path, made = self._at("versions", f"{version:012d}.json"), self._at("making", uuid.uuid4().hex)
        out = self._fs.create(made, False)
        try:
            out.write(json.dumps(content).encode())
        finally:
            out.close()
        with _PUBLISHING:
            self._fs.mkdirs(path.getParent())
            if self._fs.exists(path) or not self._fs.rename(made, path):
                self._fs.delete(made, False)
                raise Conflict(path.toString())

    def publish(self, change: Callable[[dict], dict | None]) -> int:
        """Publishes what change makes of the last version, as often as another writer comes first; None: nothing is to be done."""
        while True:
            now = self.version()
            made = change(self.manifest(now))
            if made is None:
                return now
            try:
                self._create(now + 1, made)
                return now + 1
            except Conflict:
                continue

    # --- writes ---

    def bucket(self, of: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(of or self.buckets)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows by tasks of a bucket or few; with BUCKET, by which Spark knows that they need no other shuffle to be grouped by it and a key."""
        return rows.withColumn(BUCKET, self.bucket()).repartition(SPREAD * self.buckets, BUCKET)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A set of rows (with GONE; with BUCKET if they are dealt), in a file a bucket and task; its name and the buckets it has."""
        name = uuid.uuid4().hex
        place = f"{self.path}/data/{name}"
        rows = rows if BUCKET in rows.columns else self.dealt(rows)
        # a task has few buckets: it writes them side by side instead of sorting its rows by them, which may be far larger than what they are made of
        with _side_by_side(rows.sparkSession, self.buckets):
            rows.write.partitionBy(BUCKET).option("compression", "zstd").parquet(place)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at("data", name))]
        return name, sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{BUCKET}="))

    def _add(self, rows: DataFrame, stream: str | None, batch: int | None) -> int:
        def applied(m: dict) -> bool:
            return stream is not None and m["batches"].get(stream, -1) >= batch

        if applied(self.manifest()):
            return self.version()
        name, met = self._write(rows)

        def change(m: dict) -> dict | None:
            if applied(m) or (not met and stream is None):
                return None
            sets = [*m["sets"], [name, met]] if met else m["sets"]
            return {"sets": sets, "batches": m["batches"] | ({stream: batch} if stream else {})}

        return self.publish(change)

    def _tombstones(self, keys: DataFrame) -> DataFrame:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
        by = [BUCKET, *self.keys] if BUCKET in keys.columns else self.keys
        return keys.select(*by).distinct().select(*by, *rest).select(*by[: -len(self.keys)], *self.schema.names).withColumn(GONE, F.lit(True))

    def replace(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, emptied: DataFrame | None = None) -> int:
        """Gives every key of rows these rows instead of those it has; keys of emptied that have no rows here have none from now on. The version that holds them is returned.

        Rows, and those of emptied, that have BUCKET lie as dealt() has dealt them, and are not moved.
        """
        rows = rows.select(*([BUCKET] if BUCKET in rows.columns else []), *self.schema.names).withColumn(GONE, F.lit(False))
        # a tombstone beside rows of its key in one set says nothing
        return self._add(rows if emptied is None else rows.unionByName(self._tombstones(emptied)), stream, batch)

    def upsert(self, rows: DataFrame, order: Column, stream: str | None = None, batch: int | None = None) -> int:
        """One row a key: the last of rows by order, if the key has none that is later."""
        last = self._last_by(rows.select(*self.schema.names), order)
        known = self.lookup(last.select(*self.keys))
        both = last.withColumn("_new", F.lit(1)).unionByName(known.withColumn("_new", F.lit(0)))
        rest = [c for c in both.columns if c not in self.keys]
        won = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row")).filter("_row._new = 1")
        return self.replace(won.select(*self.keys, *(F.col(f"_row.`{c}`") for c in rest if c != "_new")), stream, batch)

    def add_up(self, rows: DataFrame, numbers: list[str], stream: str, batch: int) -> int:
        """Adds the numbers of rows (one row a key) to those of their keys, once a batch; keys that are new get them as they are.

        The sums are made of one version and published as the next: if another writer comes first, they are made anew.
        """
        rows = rows.select(*self.schema.names)
        while True:
            now = self.version()
            before = self.manifest(now)
            if before["batches"].get(stream, -1) >= batch:
                return now
            sums = self.read(now).unionByName(rows).groupBy(*self.keys).agg(*(F.sum(n).alias(n) for n in numbers))
            name, met = self._write(sums.select(*self.schema.names).withColumn(GONE, F.lit(False)))
            try:  # the new set has all keys
                self._create(now + 1, {"sets": [[name, met]] if met else before["sets"], "batches": before["batches"] | {stream: batch}})
                return now + 1
            except Conflict:
                continue

    def _last_by(self, rows: DataFrame, order: Column) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
        return last.select(*self.keys, *(F.col(f"_row.`{c}`") for c in rest)).select(rows.columns)

    def delete(self, keys: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """The keys have no rows from now on."""
        return self._add(self._tombstones(keys), stream, batch)

    def expire(self, as_of, days: int, updated: str) -> int:
        """Keys whose rows were all updated more than days before as_of have none from now on."""
        last = self.read().groupBy(*self.keys).agg(F.max(updated).alias("_last"))
        return self.delete(last.filter(F.col("_last") < F.lit(as_of) - F.expr(f"interval {days} days")))

    # --- reads ---

    def _schema(self) -> StructType:
        return StructType([*self.schema.fields]).add(GONE, "boolean")

    def _set(self, name: str, buckets: list[int], order: int) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/data/{name}").schema(self._schema().add(BUCKET, "integer"))
        rows = rows.parquet(*(f"{self.path}/data/{name}/{BUCKET}={b}" for b in buckets))
        return rows.withColumn(ORDER, F.lit(order))

    def _rows(self, sets: list[list], only: set[int] | None = None) -> DataFrame:
        """The rows that count: buckets of one set as they are, the others merged by key."""
        sets = [[name, [b for b in buckets if only is None or b in only]] for name, buckets in sets]
        count: dict[int, int] = {}
        for _, buckets in sets:
            for b in buckets:
                count[b] = count.get(b, 0) + 1
        parts, older, newer, met = [], [], [], set()
        for order, (name, buckets) in enumerate(sets):
            for target, mine in ((parts, [b for b in buckets if count[b] == 1]), (older, [b for b in buckets if count[b] > 1 and b not in met]), (newer, [b for b in buckets if count[b] > 1 and b in met])):
                if mine:
                    target.append(self._set(name, mine, order))
            met |= set(buckets)
        union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
        if newer:
            late = union(newer)
            last = late.withColumn("_last", F.max(ORDER).over(Window.partitionBy(*self.keys))).filter(F.col(ORDER) == F.col("_last")).drop("_last")
            same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in self.keys]
            # Spark broadcasts the changed keys if they are few
            parts += [union(older).alias("o").join(late.select(*self.keys).distinct().alias("n"), same, "left_anti"), last]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return union(parts).filter(~F.col(GONE)).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["sets"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are read."""
        asked = {r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most buckets rows
        rows = self._rows(self.manifest()["sets"], asked)
        same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"k.`{k}`")) for k in self.keys]
        return rows.alias("r").join(keys.select(*self.keys).distinct().alias("k"), same, "left_semi")

    # --- upkeep ---

    def compact(self, gathered: int = GATHERED) -> list[int]:
        """Rewrites the buckets that have gathered so many sets, each into one; gives these buckets."""
        sets = self.manifest()["sets"]
        count: dict[int, int] = {}
        for _, buckets in sets:
            for b in buckets:
                count[b] = count.get(b, 0) + 1
        touched = sorted(b for b, n in count.items() if n >= gathered)
        if not touched:
            return []
        name, met = self._write(self._rows(sets, set(touched)).withColumn(GONE, F.lit(False)))
        old = {n for n, _ in sets}
        done = []

        def change(m: dict) -> dict | None:
            done.clear()
            here = {n: set(b) for n, b in m["sets"]}
            if any(n not in here or not set(b) & set(touched) <= here[n] for n, b in sets if set(b) & set(touched)):
                return None  # another writer has compacted some of these
            kept, place = [], None
            for n, b in m["sets"]:
                if n in old and set(b) & set(touched):
                    place = len(kept) if place is None else place
                    b = [x for x in b if x not in touched]
                if b:
                    kept.append([n, b])
            done.append(True)
            return {"sets": [*kept[:place], *([[name, met]] if met else []), *kept[place:]], "batches": m["batches"]}

        self.publish(change)
        return touched if done else []

    def vacuum(self, versions: int = 2) -> int:
        """Deletes sets that none of the last versions names, and the files of older versions; no write may be under way. Gives the number of sets deleted."""
        last = self.version()
        live = {n for v in range(max(1, last - versions + 1), last + 1) for n, _ in self.manifest(v)["sets"]}
        folder = self._at("data")
        gone = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName() not in live] if self._fs.exists(folder) else []
        for path in gone:
            self._fs.delete(path, True)
        for f in self._fs.listStatus(self._at("versions")) if last else []:
            name = f.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) <= last - versions:
                self._fs.delete(f.getPath(), False)
        return len(gone)
