"""Scalar functions: all are expressions over columns, so they stay inside generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token, by model family; `plain` and `code` are picked by the text itself.
RATIOS = {"claude": 3.3, "gemini": 3.4, "openai": 3.2, "code": 3.2, "plain": 3.8}
#: What marks a text as code.
CODE_MARKS = ("def ", "function ", "class ", "{", "}", "import ", ";")
CODE_PREFIX = 500
#: Fixed value: dollars for a million tokens.
DOLLARS_PER_MILLION = 3.00


#: Terminal codes: colours and cursor, titles, character sets, carriage returns.
TERMINAL = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b\([B0UK]|\r"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def est_chars4(text: str | Column) -> Column:
    """A quarter of the characters, at least 1; 0 for empty text, null for null."""
    t = col(text)
    return F.when(t.isNull(), F.lit(None)).when(t == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / 4))).cast("long")


def est_ratio(text: str | Column, family: str = "auto") -> Column:
    """Characters by the family's ratio, truncated, at least 1; 0 for empty text, null for null. auto looks for marks of code near the start."""
    t = col(text)
    if family == "auto":
        head = F.substring(t, 1, CODE_PREFIX)
        code = reduce(lambda a, b: a | b, (head.contains(m) for m in CODE_MARKS))
        ratio = F.when(code, F.lit(RATIOS["code"])).otherwise(F.lit(RATIOS["plain"]))
    else:
        ratio = F.lit(RATIOS[family])
    return F.when(t.isNull(), F.lit(None)).when(t == "", 0).otherwise(F.greatest(F.lit(1), (F.length(t) / ratio).cast("long"))).cast("long")


def strip_ansi(text: str | Column) -> Column:
    """Without colour and cursor codes, titles, character sets and carriage returns."""
    return F.regexp_replace(col(text), TERMINAL, "")


def trim_ws(text: str | Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def content_hash(x: str | Column) -> Column:
    return F.sha2(col(x), 256)


def short_hash(x: str | Column) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 16)


def saved_pct(original: str | Column, optimized: str | Column) -> Column:
    """Percent saved; 0 without an original or if nothing is saved."""
    o, n = col(original), col(optimized)
    return F.when(o > 0, F.greatest(F.lit(0.0), (o - n) / o * 100)).otherwise(F.lit(0.0))


def dollars(tokens: str | Column) -> Column:
    return col(tokens) / 1e6 * DOLLARS_PER_MILLION


def _trigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dice(a: str | Column, b: str | Column) -> Column:
    """Twice the common trigrams over all of both sets; 0 if either text has none."""
    x, y = _trigrams(col(a)), _trigrams(col(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def edit_similarity(x: Column, y: Column) -> Column:
    return 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def best_similarity(q: Column, t: Column, qc: Column, tc: Column, *others: Column) -> Column:
    """similarity() of texts in lower case (q, t), these without separators (qc, tc), and what others tell of them: edit distance and trigram Dice."""
    ratio = F.least(F.length(qc), F.length(tc)) / F.greatest(F.length(qc), F.length(tc), F.lit(1))
    inside = F.when((qc != "") & (tc != "") & (qc.contains(tc) | tc.contains(qc)) & (ratio >= 0.4), 0.75 + 0.20 * ratio).otherwise(F.lit(0.0))
    return F.when(q == t, F.lit(1.0)).when(qc == tc, F.lit(0.98)).otherwise(F.greatest(inside, *others))


def similarity(query: str | Column, name: str | Column) -> Column:
    """0 to 1. Equal but for case: 1; but for separators: 0.98; else the best of containment, edit distance and trigram Dice."""
    q, t = F.lower(col(query)), F.lower(col(name))
    qc, tc = (F.regexp_replace(x, r"(?U)[_\-\s]", "") for x in (q, t))
    return best_similarity(q, t, qc, tc, edit_similarity(q, t), edit_similarity(qc, tc), dice(q, t))


def like_contains(name: str | Column, needle: str) -> Column:
    """name holds needle, in any case; % _ and \\ in needle stand for themselves."""
    return col(name).ilike("%" + re.sub(r"([\\%_])", r"\\\1", needle) + "%")


def key_base(key: str | Column) -> Column:
    """The path of a read key, slashes forward, without the fragment from the first # on."""
    return F.regexp_replace(F.substring_index(col(key), "#", 1), r"\\", "/")


def key_fragment(key: str | Column) -> Column:
    k = col(key)
    return F.when(k.contains("#"), F.regexp_extract(k, r"(?s)^[^#]*#(.*)$", 1))


def canonical_path(path: str | Column) -> Column:
    """A path with slashes forward and without `.`, empty and undone segments; a relative path keeps the .. that lead out of it, and an empty one is `.`."""
    p = F.regexp_replace(col(path), r"\\", "/")
    rooted = p.startswith("/")

    def step(out: Column, s: Column) -> Column:
        undone = (F.size(out) > 0) & (F.element_at(out, -1) != "..")
        up = F.when(undone, F.slice(out, F.lit(1), F.size(out) - 1)).when(rooted, out).otherwise(F.concat(out, F.array(s)))
        return F.when(s.isin("", "."), out).when(s == "..", up).otherwise(F.concat(out, F.array(s)))

    # a null makes element_at of an empty array null, which when() passes over
    kept = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def read_key(key: str | Column) -> Column:
    """A read key as a struct: path (canonical), kind (file, lines or symbol), start, end and symbol; of #L5, #L5-9 and #L5-L9 the lines are a slice."""
    part = key_fragment(key)
    lines = r"^L(\d+)(?:-L?(\d+))?\z"
    sliced = part.rlike(lines)
    number = lambda k: F.expr("cast(null as int)") if k is None else F.try_to_number(F.regexp_extract(part, lines, k), F.lit("9999999999")).cast("int")
    end = F.when(F.regexp_extract(part, lines, 2) == "", number(1)).otherwise(number(2))
    kind = F.when(part.isNull(), "file").when(sliced, "lines").otherwise("symbol")
    return F.struct(
        canonical_path(F.substring_index(col(key), "#", 1)).alias("path"), kind.alias("kind"), F.when(sliced, number(1)).alias("start"), F.when(sliced, end).alias("end"), F.when(~sliced, part).alias("symbol")
    )


#: Elements that a growing array gathers before they are put away.
GATHERED = 64


def gathering(kind: str) -> dict[str, Column]:
    """Fields of an aggregate's state that gather elements of a type: into a short array, which is put away when it is full.

    An array that grows by one element at a time is copied as often; so each element is copied GATHERED times at most, and
    once for each GATHERED * GATHERED elements after it.
    """
    return {"_some": F.expr(f"cast(array() as array<{kind}>)"), "_away": F.expr(f"cast(array() as array<array<{kind}>>)")}


def gather(acc: Column, element: Column, wanted: Column) -> list[Column]:
    """The fields after an element, if it is wanted."""
    some = F.when(wanted, F.concat(acc["_some"], F.array(element))).otherwise(acc["_some"])
    full = F.size(acc["_some"]) >= GATHERED
    # what is full is put away before the next element comes
    return [F.when(full, F.when(wanted, F.array(element)).otherwise(F.slice(acc["_some"], 1, 0))).otherwise(some).alias("_some"), F.when(full, F.concat(acc["_away"], F.array(acc["_some"]))).otherwise(acc["_away"]).alias("_away")]


def gathered(acc: Column) -> Column:
    return F.concat(F.flatten(acc["_away"]), acc["_some"])


def version_parts(version: str | Column) -> Column:
    """The numbers of a version such as v1.2.3; parts that are none (or of more than 32 bits) are passed over."""
    parts = F.split(F.regexp_replace(col(version), "^v+", ""), r"\.", -1)
    numbers = F.filter(parts, lambda x: x.rlike(r"^\+?[0-9]+\z"))
    return F.filter(F.transform(numbers, lambda x: x.cast("decimal(38,0)")), lambda n: n < F.lit(1 << 32))


def is_newer(latest: str | Column, current: str | Column) -> Column:
    """Whether latest comes after current, part by part; of equal parts, the longer one is newer."""
    return version_parts(latest) > version_parts(current)
