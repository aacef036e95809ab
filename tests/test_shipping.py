"""The package runs from a place that cannot be written to."""

import os
import shutil
import stat
import subprocess
import sys
import zipfile

import siftwork
from siftwork import shipping


def test_the_zip_holds_sources_only():
    place = os.path.dirname(os.path.abspath(siftwork.__file__))
    names = zipfile.ZipFile(shipping._zipped(place)).namelist()
    assert "siftwork/shipping.py" in names and "siftwork/operators/logs.py" in names and all(n.endswith(".py") for n in names)


def test_a_read_only_copy_works(tmp_path):
    place = os.path.dirname(os.path.abspath(siftwork.__file__))
    copy = tmp_path / "lib" / "siftwork"
    shutil.copytree(place, copy, ignore=shutil.ignore_patterns("__pycache__"))
    for at, _, files in os.walk(copy, topdown=False):
        for f in files:
            os.chmod(os.path.join(at, f), stat.S_IREAD)
        os.chmod(at, stat.S_IREAD | stat.S_IEXEC)
    script = """
import builtins, os, sys
place = sys.argv[1]
real = builtins.open
def guarded(name, mode="r", *a, **k):  # root may write anywhere
    if any(c in mode for c in "wax+") and str(name).startswith(place):
        raise OSError(30, "Read-only file system", name)
    return real(name, mode, *a, **k)
builtins.open = guarded
sys.dont_write_bytecode = True
from pyspark.sql import SparkSession
from siftwork import shipping
assert shipping.__file__.startswith(place)
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
shipping.ship(spark)
from pyspark.sql import functions as F
from siftwork.operators import code
rows = spark.createDataFrame([("a.py", "python", "def f(x):\\n    return x\\n")], "file_path string, lang string, text string")
print("rows", rows.count())
"""
    env = os.environ | {"PYTHONPATH": str(tmp_path / "lib")}
    try:
        out = subprocess.run([sys.executable, "-c", script, str(tmp_path / "lib")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    finally:
        for at, _, _ in os.walk(copy):
            os.chmod(at, stat.S_IRWXU)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
    assert not list(copy.rglob("__pycache__"))
