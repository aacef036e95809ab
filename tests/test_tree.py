"""The source of trees against os.walk, its filters, and its sink's commit and abort."""

import os

import pytest
from pyspark.sql import functions as F

from siftwork.shipping import ship
from siftwork.sources import files, tree


@pytest.fixture
def root(tmp_path, spark):
    ship(spark)
    for name in ("a.py", "pkg/__init__.py", "pkg/_private/x.py", ".hidden/y.rs", "pkg/sub/deep/z.go", "_top.js", "pkg/empty.py", "with space/é.py", "node_modules/m.js"):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if "empty" in name else f"text of {name}")
    (tmp_path / "src" / "no files").mkdir()
    return str(tmp_path / "src")


@pytest.mark.parametrize("split", [1, 3, 256])
def test_tree_equals_walk(spark, root, split):
    want = {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs}
    rows = tree.list_tree(spark, root, True, split).collect()
    assert {r["rel_path"]: r["length"] for r in rows} == want and len(rows) == len(want)
    assert all(bytes(r["content"]) == open(os.path.join(root, r["rel_path"]), "rb").read() and r["mtime"] is not None for r in rows)
    assert tree.list_tree(spark, os.path.join(root, "no files")).count() == 0


def test_filters_are_pushed(spark, root):
    rows = tree.list_tree(spark, root).filter((F.col("rel_path").endswith(".py")) & (F.col("length") > 0) & F.col("rel_path").contains("pkg"))
    assert {r["rel_path"] for r in rows.collect()} == {"pkg/__init__.py", "pkg/_private/x.py"}
    reader = tree.TreeReader(root, False, 4)
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringEndsWith

    left = list(reader.pushFilters([StringEndsWith(("rel_path",), ".py"), IsNotNull(("content",)), EqualTo(("mtime",), 1)]))
    assert len(left) == 2 and not reader.tests.hold("x", "a.rs", 1) and reader.tests.hold("x", "a.py", 1)


def test_hidden_sources_are_read(spark, root):
    rows = files.read_sources(spark, root, hidden=True)
    assert {(r["file_path"], r["lang"]) for r in rows.select("file_path", "lang").collect()} >= {("pkg/__init__.py", "python"), ("_top.js", "javascript"), ("a.py", "python")}
    assert not rows.filter("file_path LIKE 'node_modules%' OR file_path LIKE '.hidden%'").count()  # a walk leaves these folders out
    assert {r["rel_path"] for r in files.list_files(spark, root, hidden=True).collect()} > {r["rel_path"] for r in files.list_files(spark, root).collect()}


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    ship(spark)
    tree.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(0, 100, 1, 4).withColumn("x", F.col("id") * 2)
    rows.write.format("source_tree").mode("append").save(path)
    assert spark.read.parquet(path).count() == 100
    bad = rows.withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("source_tree").mode("append").save(path)
    assert sorted(os.listdir(path)) == [f for f in sorted(os.listdir(path)) if f.endswith(".parquet")] and spark.read.parquet(path).count() == 100
    rows.limit(7).write.format("source_tree").mode("overwrite").save(path)
    assert spark.read.parquet(path).count() == 7
