"""Code queries over modules in several languages, which vary by row.

~ stands for a part's key and ¤ for its size. Beside each module stand its skeleton and its symbols, written by hand from
what the text says, so that SQL states the expected rows without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code
from .registry import query, table

#: language, extension, module, skeleton, symbols (name, kind, line, end line), imports.
MODULES = (
    ("python", "py", '''import os
from a import b


@cached
async def f~(x):
    """Say it.

    Twice.
    """
    def inner~(y):
        return y + ¤
    return inner~(x)
''', '''import os
from a import b


@cached
async def f~(x):
    """Say it.

    Twice.
    """
    ...
''', (("f~", "function", 6, 13), ("inner~", "function", 11, 12)), 2),
    ("python", "py", '''class C~(Base):
    """A class."""

    size = ¤

    @property
    def m~(self):
        return self.size

    class D~:
        def n~(self): return 1
''', '''class C~(Base):
    """A class."""

    size = ¤

    @property
    def m~(self):
        ...

    class D~:
        def n~(self): ...
''', (("C~", "class", 1, 11), ("m~", "method", 7, 8), ("D~", "class", 10, 11), ("n~", "method", 11, 11)), 0),
    ("python", "py", '''import re

def g~(x):
    s = "def no~(x):"  # def never~():
    if x:
        return s
    return ¤

def h~():
    pass
''', '''import re

def g~(x):
    ...

def h~():
    ...
''', (("g~", "function", 3, 7), ("h~", "function", 9, 10)), 1),
    ("go", "go", '''package p~

import "fmt"

type S~ struct {
\tsize int
}

func (s *S~) M~(x int) int {
\tif x > ¤ {
\t\treturn x
\t}
\treturn s.size
}
''', '''package p~

import "fmt"

type S~ struct {
\tsize int
}

func (s *S~) M~(x int) int {
  ...
}
''', (("S~", "struct", 5, 7), ("M~", "method", 9, 14)), 1),
    ("go", "go", '''package q~

type I~ interface {
\tRun() error
}

func F~(a, b string) (string, error) {
\tg := func() string {
\t\treturn "}"
\t}
\treturn g(), nil // }
}
''', '''package q~

type I~ interface {
\tRun() error
}

func F~(a, b string) (string, error) {
  ...
}
''', (("I~", "interface", 3, 5), ("F~", "function", 7, 12)), 0),
    ("rust", "rs", '''use std::fmt;

pub struct S~ {
    size: u32,
}

impl S~ {
    pub fn m~(&self, x: u32) -> u32 {
        if x > ¤ {
            return x;
        }
        self.size
    }
}
''', '''use std::fmt;

pub struct S~ {
    size: u32,
}

impl S~ {
    pub fn m~(&self, x: u32) -> u32 {
  ...
}
}
''', (("S~", "struct", 3, 5), ("m~", "method", 8, 13)), 1),
    ("rust", "rs", '''pub trait T~ {
    fn run(&self) -> u32;
}

pub async fn f~<T: Copy>(x: T) -> T {
    fn inner~(y: u32) -> u32 {
        y + ¤
    }
    let s = "}"; // }
    x
}
''', '''pub trait T~ {
    fn run(&self) -> u32;
}

pub async fn f~<T: Copy>(x: T) -> T {
  ...
}
''', (("T~", "interface", 1, 3), ("f~", "function", 5, 11), ("inner~", "function", 6, 8)), 0),
    ("java", "java", '''import java.util.List;

public class C~ extends Base {
    private int size = ¤;

    @Override
    public int m~(int x) throws Error {
        if (x > ¤) {
            return x;
        }
        return size;
    }
}
''', '''import java.util.List;

public class C~ extends Base {
    private int size = ¤;

    @Override
    public int m~(int x) throws Error {
  ...
}
}
''', (("C~", "class", 3, 13), ("m~", "method", 6, 12)), 1),
    ("java", "java", '''public interface I~ {
    int run(int x);
}

class D~ {
    D~(String s) {
        this.s = "}"; // }
    }

    static class E~ {
        void n~() {
            run();
        }
    }
}
''', '''public interface I~ {
    int run(int x);
}

class D~ {
    D~(String s) {
  ...
}

    static class E~ {
        void n~() {
  ...
}
    }
}
''', (("I~", "interface", 1, 3), ("D~", "class", 5, 15), ("D~", "method", 6, 8), ("E~", "class", 10, 14), ("n~", "method", 11, 13)), 0),
    ("typescript", "ts", '''import { a } from "b";

export class C~ extends Base {
  size: number = ¤;

  async m~(x: number): Promise<number> {
    if (x > ¤) {
      return x;
    }
    return this.size;
  }
}
''', '''import { a } from "b";

export class C~ extends Base {
  size: number = ¤;

  async m~(x: number): Promise<number> {
  ...
}
}
''', (("C~", "class", 3, 12), ("m~", "method", 6, 11)), 1),
    ("typescript", "ts", '''export interface I~ {
  run(x: number): void;
}

export function f~(x: number): number {
  const s = "}"; // }
  return x;
}

export const g~ = async (y: string) => {
  return y;
};
''', '''export interface I~ {
  run(x: number): void;
}

export function f~(x: number): number {
  ...
}

export const g~ = async (y: string) => {
  ...
};
''', (("I~", "interface", 1, 3), ("f~", "function", 5, 8), ("g~", "function", 10, 12)), 0),
)
LANGUAGES = tuple(dict.fromkeys(m[0] for m in MODULES))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def modules(spark, sf_dir, language: str) -> DataFrame:
    """file_path, text, lang: a module for each part, of the language's kinds in turn."""
    kinds = [m for m in MODULES if m[0] == language]
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    place = (F.col("p_partkey") % len(kinds)).cast("int")
    body = F.get(F.array(*(F.lit(m[2]) for m in kinds)), place)
    text = F.replace(F.replace(body, F.lit("~"), key), F.lit("¤"), size)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m"), key, F.lit(f".{kinds[0][1]}")).alias("file_path"), text.alias("text"), F.lit(language).alias("lang"))


def _skeleton_sql(language: str) -> str:
    kinds = [m for m in MODULES if m[0] == language]
    case = " ".join(f"WHEN {i} THEN {_quoted(m[3])}" for i, m in enumerate(kinds))
    count = " ".join(f"WHEN {i} THEN {m[5]}" for i, m in enumerate(kinds))
    fill = lambda x: f"replace(replace({x}, '~', p_partkey::VARCHAR), '¤', p_size::VARCHAR)"
    body = " ".join(f"WHEN {i} THEN {_quoted(m[2])}" for i, m in enumerate(kinds))
    tokens = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, length({x}) // 4) END)::BIGINT"
    return f"""WITH s AS (SELECT 'm' || p_partkey || '.{kinds[0][1]}' AS file_path, {fill(f'CASE p_partkey % {len(kinds)} {case} END')} AS skeleton, {fill(f'CASE p_partkey % {len(kinds)} {body} END')} AS t, (CASE p_partkey % {len(kinds)} {count} END)::INT AS n_imports FROM part)
SELECT file_path, 'ok' AS status, skeleton, {tokens('t')} AS orig_tokens, {tokens('skeleton')} AS opt_tokens, n_imports FROM s"""


def _symbols_sql(language: str) -> str:
    kinds = [m for m in MODULES if m[0] == language]
    values = ", ".join(f"({i}, {k}, '{name}', '{kind}', {line}, {end})" for i, m in enumerate(kinds) for k, (name, kind, line, end) in enumerate(m[4]))
    return f"SELECT 'm' || p_partkey || '.{kinds[0][1]}' AS file_path, replace(k.n, '~', p_partkey::VARCHAR) AS name, k.kind, k.line::INT AS line, k.e::INT AS end_line FROM part JOIN (VALUES {values}) k(v, o, n, kind, line, e) ON p_partkey % {len(kinds)} = k.v"


def _register(language: str) -> None:
    def skeletons(spark, sf_dir):
        files = code.with_imports(modules(spark, sf_dir, language))
        return code.skeletons(files, ("n_imports",)).select("file_path", "status", "skeleton", "orig_tokens", "opt_tokens", "n_imports")

    def symbols(spark, sf_dir):
        return code.symbols(modules(spark, sf_dir, language)).select("file_path", "name", "kind", "line", "end_line")

    query(_skeleton_sql(language), f"skeleton_{language}")(skeletons)
    query(_symbols_sql(language), f"symbols_{language}")(symbols)


for _language in LANGUAGES:
    _register(_language)
