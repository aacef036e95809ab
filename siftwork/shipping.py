"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def _zipped(place: str) -> str:
    """A zip of the package's sources in a folder of the driver's own, which is deleted when the driver ends. Nothing is written where the package lies."""
    name = os.path.basename(place)
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, folders, files in os.walk(place):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for f in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(at, f)
                out.write(full, os.path.join(name, os.path.relpath(full, place)))
    return path


def ship(spark: SparkSession) -> None:
    """Once an application, adds a zip of the package to its Python files, which Spark hands to every worker.

    So workers need not be started where the package lies. The zip itself stays on the driver, which serves it.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    place = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(place):  # the package already came in a zip
        return
    context.addPyFile(_zipped(place))
    _SENT.add(context.applicationId)


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bounds the Arrow batches of the session's Python workers by rows and bytes, as texts may be long; bounds that are lower already are left."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = str(spark.conf.get(key, None) or "").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
