"""A local session, and DuckDB over the smallest tables."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Checks that a DataFrame and a DuckDB result hold the same rows."""

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        df = df.where(df.notna(), None)
        return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)

    def check(result, expected):
        got = result.toPandas()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)

    return check
