"""Parsing: symbols, skeletons, references."""

import re

import pytest

from siftwork.functions import parsing

PYTHON = 'import os\nfrom a import b\n\nclass Foo(Base):\n    """Doc."""\n    def run(self, x):\n        """Say."""\n        def inner():\n            return 1\n        return helper(x)\n\nasync def helper(x): return b(x)\n'
SAMPLES = {
    "go": ("package m\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) Run(a int) error {\n\tif a > 0 {\n\t\treturn nil\n\t}\n\treturn nil\n}\n", [("S", "struct", 3, 5), ("Run", "method", 7, 12)]),
    "java": ("public class A extends B {\n  public String getName(int a) {\n    if (a > 1) { return null; }\n    return name;\n  }\n}\n", [("A", "class", 1, 6), ("getName", "method", 2, 5)]),
    "rust": ("impl P {\n  pub fn new(x: i32) -> Self {\n    P { x }\n  }\n}\nfn main() {\n  run();\n}\nenum E { A }\n", [("new", "method", 2, 4), ("main", "function", 6, 8), ("E", "enum", 9, 9)]),
    "javascript": ("function foo(a) {\n  return '}';\n}\nclass K extends L {\n  bar(x) {\n    return foo(x);\n  }\n}\nconst z = (a) => {\n  return 1;\n};\n", [("foo", "function", 1, 3), ("K", "class", 4, 8), ("bar", "method", 5, 7), ("z", "function", 9, 11)]),
    "cpp": ("class W {\npublic:\n  void draw() {\n    x = 1; // }\n  }\n};\nint add(int a, int b) {\n  return a + b;\n}\n", [("W", "class", 1, 6), ("draw", "method", 3, 5), ("add", "function", 7, 9)]),
    "ruby": ("class Foo\n  def bar(x)\n    x + 1\n  end\nend\n", [("Foo", "class", 1, 5), ("bar", "method", 2, 4)]),
    "kotlin": ("class A {\n  fun go(x: Int): Int {\n    return x\n  }\n}\n", [("A", "class", 1, 5), ("go", "method", 2, 4)]),
    "typescript": ("export class U {\n  private async load(id: string): Promise<void> {\n    await x(id);\n  }\n}\ninterface I {\n  a: string;\n}\n", [("U", "class", 1, 5), ("load", "method", 2, 4), ("I", "interface", 6, 8)]),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_symbols(language):
    source, want = SAMPLES[language]
    assert [(s[1], s[2], s[3], s[4]) for s in parsing.symbols(source, language)] == want
    short = parsing.skeleton(source, language)
    assert "..." in short and len(short) <= len(source) + 10 * len(want)


def test_python():
    assert [(s[1], s[2], s[3], s[4], s[7]) for s in parsing.symbols(PYTHON, "python")] == [("Foo", "class", 4, 10, 0), ("run", "method", 6, 10, 1), ("inner", "function", 8, 9, 2), ("helper", "function", 12, 12, 0)]
    short = parsing.skeleton(PYTHON, "python")
    assert '"""Say."""\n        ...' in short and "inner" not in short and "return" not in short and short.endswith("def helper(x): ...\n")
    refs = {(o[1], o[3]) for o in parsing.occurrences(PYTHON, "python") if not o[5]}
    assert {("Base", "INHERITANCE"), ("helper", "CALL"), ("b", "IMPORT"), ("b", "CALL"), ("x", "CALL")} <= refs
    assert parsing.imports(PYTHON, "python") == 2


def test_broken_python_falls_back():
    found = parsing.symbols("class A:\n    def f(self):\n        return (\n\ndef g():\n    pass\n", "python")
    assert [(s[1], s[2], s[3], s[4]) for s in found] == [("A", "class", 1, 3), ("f", "method", 2, 3), ("g", "function", 5, 6)]


def test_unsupported_and_empty(spark):
    from siftwork.operators import code

    assert parsing.skeleton("body { }", "css") is None and parsing.symbols("", "python") == []
    files = spark.createDataFrame([("a.css", "p {}", "css"), ("b.py", "", "python"), ("c.py", None, "python")], "file_path string, text string, lang string")
    got = {r["file_path"]: (r["status"], r["skeleton"]) for r in code.skeletons(files).collect()}
    assert got["a.css"] == ("unsupported", "p {}") and got["b.py"] == ("ok", "")


def test_get_symbol(spark):
    from siftwork.operators import code

    files = spark.createDataFrame([("a.py", PYTHON, "python")], "file_path string, text string, lang string")
    r = code.get_symbol(files, "run").first()
    assert (r["status"], r["line"], r["end_line"]) == ("found", 6, 10)
    r = code.get_symbol(files, "helpr").first()
    assert r["status"] == "missing" and r["suggestions"][0] == "helper"


def test_references_and_blast(spark):
    from siftwork.operators import code, search

    rows = [("a.py", "def f():\n    pass\n", "python"), ("b.py", "from a import f\n\nf(f(1))\n", "python"), ("c.py", "x = 1\n", "python")]
    files = spark.createDataFrame(rows, "file_path string, text string, lang string")
    out = search.blast_radius(code.occurrences(files, "f"), code.symbols(files), "f").collect()
    assert [(r["file_path"], r["line"], r["kind"], r["total_refs"], r["total_files"]) for r in out] == [("b.py", 1, "IMPORT", 2, 1), ("b.py", 3, "CALL", 2, 1)]


def test_parsing_is_dealt_to_many_tasks_and_no_text_is_broadcast(spark):
    """Of a small table that a few tasks read, whose columns are made, so Spark expects little of them."""
    from pyspark.sql import functions as F

    from siftwork.operators import code, repomap

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = spark.range(0, 40, 1, 1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("file_path"), F.concat(F.lit("import os\ndef run"), "id", F.lit("():\n    pass\n")).alias("text"), F.lit("python").alias("lang"))
    for rows in (code.symbols(made), code.skeletons(made)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == tasks
    kept = repomap.repo_map(made.withColumn("n_imports", F.lit(1)), code.symbols(made))
    for rows in (kept, code.get_symbol(made, "rum7"), code.symbol_ranges(made, "run7")):
        assert rows.count() > 0
        # what is broadcast is a name's file or a word's match, never a file's body, text or suggestions
        for sent in rows._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[1:]:
            assert not {"_body", "text", "implementation", "_near"} & set(re.findall(r"[_a-z]+", sent.split("\n", 2)[1]))
