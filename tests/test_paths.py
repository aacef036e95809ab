"""Path predicates and configuration."""

import fnmatch

from siftwork.functions import paths
from siftwork.sources import files

NAMES = [".env", "prod.env", "secret.pem", "id_rsa", "main.py", "a/secrets/k.txt", "secrets/x", "x.key", "my.keys", "a/b/credentials.json", "a[1].txt", "Makefile", "Dockerfile.dev", "a/CMakeLists.txt", "x.PY", "x.tar.gz", ".hidden", "node_modules/a.js", "a/.git/b", "a\\b\\c.pem"]


def test_predicates(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "path string")
    got = {r[0]: r[1:] for r in df.select("path", paths.is_secret("path"), paths.language_of("path"), paths.in_skipped_folder("path"), paths.is_binary("path")).collect()}
    for n in NAMES:
        p = n.replace("\\", "/")
        want = any(fnmatch.fnmatchcase(x, g) for g in paths.SECRET_GLOBS for x in (p, p.rsplit("/", 1)[-1])) or fnmatch.fnmatchcase(p, "*/secrets/*")
        assert got[n][0] == want, n
    assert [got[n][1] for n in ("Makefile", "Dockerfile.dev", "a/CMakeLists.txt", "x.PY", ".hidden")] == ["make", "dockerfile", "cmake", "python", None]
    assert got["node_modules/a.js"][2] and got["a/.git/b"][2] and not got[".hidden"][2]
    assert got["x.tar.gz"][3] and not got["main.py"][3]


def test_glob_sets(spark):
    import re

    for glob in ("a[bc]*", "[!x]y", "a?c", "*.min.js", "a[", "x[a-c]z"):
        for name in ("abz", "acq", "xy", "zy", "abc", "q.min.js", "a[", "xbz", "xdz"):
            assert bool(re.search(paths.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_config():
    c = files.read_config('[general]\nmax_source_files = 7\nignore_patterns = ["*.bak", "*.pem"]\nother = 1\n')
    assert c.max_source_files == 7 and c.ignore_patterns[:8] == paths.SECRET_GLOBS and c.ignore_patterns[8:] == ("*.bak",)
    assert files.read_config("max_cacheable_bytes = 9").max_cacheable_bytes == 9
    assert files.read_config("not toml [") == files.Config()
    assert files.read_config('{"cache_ttl_days": 3}', "json").cache_ttl_days == 3


def test_sources(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.rs": "fn é() {}".encode("latin-1"), "node_modules/c.js": b"1", "k.pem": b"1", "p.png": b"1", "n.txt": b"n", "big.py": b"#" * 99, "q.unknown": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.read_sources(spark, str(tmp_path), files.Config(max_cacheable_bytes=50)).orderBy("walk_ord").collect()
    assert [(r["file_path"], r["lang"], r["walk_ord"]) for r in got] == [("n.txt", None, 1), ("src/a.py", "python", 2), ("src/b.rs", "rust", 3)]
    assert got[2]["text"] == "fn é() {}"
    assert files.read_sources(spark, str(tmp_path), files.Config(max_source_files=1)).count() == 1
    told = {r["file_path"]: (r["status"], r["walk_ord"]) for r in files.listed(spark, str(tmp_path), files.Config(max_cacheable_bytes=50, max_source_files=2)).collect()}
    assert told["n.txt"] == ("read", 1) and told["src/a.py"] == ("read", 2) and told["src/b.rs"] == ("OVER_CAP", None)
    assert [told[n][0] for n in ("node_modules/c.js", "k.pem", "p.png", "big.py", "q.unknown")] == ["FOLDER", "NO_SOURCE", "NO_SOURCE", "TOO_LARGE", "NO_SOURCE"]


def test_sinks(spark, tmp_path):
    """Savings are added, known projects are a sorted set."""
    place = str(tmp_path / "savings")
    rows = spark.createDataFrame([("slice", 10, 3), ("cache", 5, 0)], "category string, original long, optimized long")
    files.write_savings(rows, place)
    files.write_savings(rows, place)
    assert spark.read.parquet(place).count() == 4
    known = str(tmp_path / "projects")
    assert files.read_projects(spark, known) is None
    roots = lambda *xs: spark.createDataFrame([(x,) for x in xs], "project_root string")
    files.write_projects(spark, roots("b", "a", None), known)
    files.write_projects(spark, roots("c", "a"), known)
    assert [r["project_root"] for r in files.read_projects(spark, known).orderBy("project_root").collect()] == ["a", "b", "c"]
    names = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and p.name[0] not in "._"}
    assert {r["rel_path"] for r in files.list_files(spark, str(tmp_path)).collect()} == names


def test_empty_files_are_read(spark, tmp_path):
    """Spark's reader passes over empty files; a walk does not. Names that begin with _ stay hidden, as the README says."""
    for name in ("a b.py", "é+%41.py", "sub/init.py", "sub/_hidden.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "c d+%42.py").write_bytes(b"x")
    got = files.read_sources(spark, str(tmp_path)).collect()
    assert sorted((r["file_path"], r["text"], r["length"]) for r in got) == [("a b.py", "", 0), ("c d+%42.py", "x", 1), ("sub/init.py", "", 0), ("é+%41.py", "", 0)]


def test_canonical_keys(spark):
    """Against a stack in plain Python."""
    import random

    from siftwork.functions.scalars import canonical_path, read_key

    def plain(p):
        out = []
        for s in p.replace("\\", "/").split("/"):
            if s == ".." and out and out[-1] != "..":
                out.pop()
            elif s == ".." and not p.replace("\\", "/").startswith("/"):
                out.append(s)
            elif s not in ("", ".", ".."):
                out.append(s)
        return ("/" if p.replace("\\", "/").startswith("/") else "") + "/".join(out) or "."

    r = random.Random(1)
    given = ["", "/", ".", "..", "/..", "a//b", "C:\\x\\..\\y"] + ["".join(r.choice(["a", "bb", ".", "..", "/", "/", "\\"]) for _ in range(r.randint(1, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(p,) for p in given], "p string").select("p", canonical_path("p").alias("c")).collect()
    assert {(x["p"], x["c"]) for x in rows} == {(p, plain(p)) for p in given}
    keys = {"a/../b#L3-9": ("b", "lines", 3, 9, None), "b#L3-L9": ("b", "lines", 3, 9, None), "./b#L4": ("b", "lines", 4, 4, None), "b": ("b", "file", None, None, None), "b#Load": ("b", "symbol", None, None, "Load"), "b#": ("b", "symbol", None, None, ""), "b#x#y": ("b", "symbol", None, None, "x#y")}
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", read_key("k").alias("s")).select("k", "s.*").collect()
    assert {x["k"]: tuple(x)[1:] for x in got} == keys


def test_large_budgets_equal_the_running_sum(spark):
    from pyspark.sql import functions as F

    from siftwork.operators import repomap

    files = spark.range(3000).select(F.col("id").alias("file_path"), (F.col("id") * 7 % 50).cast("double").alias("score"), (F.col("id") % 9 + 1).alias("tokens"))
    for budget in (1, 500, 9000, 10**6):
        few, many = (sorted(map(tuple, repomap.within_budget(files, budget, 3, one_task=n).collect())) for n in (10**9, 0))
        assert few == many
    assert repomap.within_budget(files.limit(0), 100, 1, one_task=0).count() == 0
