"""Predicates over paths: globs, languages, binaries, skipped folders, lock files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

#: Files whose content is secret.
SECRET_GLOBS = ("*.env*", "*.pem", "*.key", "secrets/*", "*credentials*", "*id_rsa*", "*.pfx", "*.p12")
#: Lock files and generated assets.
LOCK_GLOBS = (
    "*package-lock.json", "*npm-shrinkwrap.json", "*yarn.lock", "*pnpm-lock.yaml", "*Cargo.lock", "*poetry.lock", "*Pipfile.lock",
    "*pdm.lock", "*composer.lock", "*Gemfile.lock", "*go.sum", "*.min.js", "*.min.css", "*.map",
)
#: Language by extension.
LANGUAGES = {
    "python": ("py", "pyi"),
    "typescript": ("ts",),
    "tsx": ("tsx",),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "c_sharp": ("cs",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "ruby": ("rb",),
    "php": ("php",),
    "swift": ("swift",),
    "scala": ("scala",),
    "r": ("r",),
    "lua": ("lua",),
    "zig": ("zig",),
    "elixir": ("ex", "exs"),
    "erlang": ("erl",),
    "haskell": ("hs",),
    "ocaml": ("ml", "mli"),
    "perl": ("pl", "pm"),
    "bash": ("sh", "bash", "zsh"),
    "dart": ("dart",),
    "julia": ("jl",),
    "sql": ("sql",),
    "html": ("html", "htm"),
    "css": ("css",),
    "scss": ("scss",),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "json": ("json",),
    "xml": ("xml",),
    "markdown": ("md",),
    "rst": ("rst",),
    "hcl": ("tf", "hcl"),
    "proto": ("proto",),
    "cmake": ("cmake",),
    "make": ("makefile", "mk"),
    "dockerfile": ("dockerfile",),
}
#: Extensions of binary files.
BINARY = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "wav", "avi", "mov", "mkv", "webm", "zip", "tar", "gz", "bz2", "xz", "7z",
    "rar", "exe", "dll", "so", "dylib", "bin", "o", "a", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "woff", "woff2", "ttf", "otf", "eot",
    "pyc", "pyo", "class", "jar", "db", "sqlite", "sqlite3",
)
#: Folders that hold no source, besides those whose name begins with a dot.
SKIPPED = (
    "node_modules", "__pycache__", "venv", "env", "dist", "build", "target", "out", "bin", "obj", "coverage", "htmlcov", "data", "logs",
)
#: Other text files that a source walk takes.
PLAIN = ("txt", "cfg", "ini")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob whose * and ? cross slashes; [..] and [!..] are sets."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "/_" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), r"\\", "/"), r"([^/]*)$", 1)


def extension(path: str | Column) -> Column:
    """The lower-case extension of the base name; a leading dot does not begin one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def matches_globs(path: str | Column, globs: tuple[str, ...]) -> Column:
    """The path or its base name matches one of the globs; a glob with a slash also matches below any folder."""
    p = F.regexp_replace(col(path), r"\\", "/")
    tests = []
    for g in (g.replace("\\", "/") for g in globs):
        tests += [p.rlike(glob_regex(g)), base_name(path).rlike(glob_regex(g))]
        if "/" in g:
            tests.append(p.rlike(glob_regex("*/" + g.lstrip("/"))))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_secret(path: str | Column, more: tuple[str, ...] = ()) -> Column:
    """Default and further globs together: further ones never replace the defaults."""
    return matches_globs(path, (*SECRET_GLOBS, *more))


def is_lock_file(path: str | Column, globs: tuple[str, ...] = LOCK_GLOBS) -> Column:
    return matches_globs(path, globs)


def is_binary(path: str | Column) -> Column:
    return extension(path).isin(*BINARY)


def in_skipped_folder(path: str | Column) -> Column:
    """A folder of the path begins with a dot or is a skipped one."""
    folders = F.slice(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), F.lit(1), F.size(F.split(col(path), r"[/\\]")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED))


def language_of(path: str | Column) -> Column:
    """The language by special file names, else by extension; null if unknown."""
    name = F.lower(base_name(path))
    by_ext = F.create_map(*(F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)))
    return (
        F.when(name.isin("makefile", "gnumakefile"), "make")
        .when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile")
        .when(name == "cmakelists.txt", "cmake")
        .otherwise(by_ext[extension(path)])
    )


def is_source(path: str | Column) -> Column:
    return ~is_binary(path) & (language_of(path).isNotNull() | extension(path).isin(*PLAIN))
