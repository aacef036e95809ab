"""Secrets in texts: fixed patterns, and high-entropy stretches by sliding-window Shannon entropy.

Candidates are maximal runs of [A-Za-z0-9+/_=-] of MIN_RUN characters or more. A candidate has a character class, and
each class has its own threshold in bits a character. A window of WINDOW characters slides over the candidate; its
entropy is log2(WINDOW) - sum(c * log2 c) / WINDOW, and that sum changes by two terms a step as the counts of one
character that enters and one that leaves are updated; the counts are packed, DIGIT bits each, in a few numbers. The span runs from the first window at or over the threshold
to the end of the last. Candidates that match the allow-list are suppressed, and so are spans inside a fixed
pattern's span, which already tells of them. With pieces, the runs of letters and digits inside a candidate are
candidates as well, with classes of their own: a separator or an allow-listed word beside a secret does not hide it.
A piece is suppressed if it matches the allow-list itself, or if its run matches a pattern of the allow-list that is
anchored at the start, as these tell what a run is. Only DataFrame functions are used.

Positions are code points, the end exclusive. Defined results: a null text counts as empty and has no spans; repeated
rows give a row each; very long texts are scanned whole; of spans with one start, the kind listed first comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gather, gathered, gathering
from .common import text_of

#: Kind, pattern, the group whose length counts, its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
MIN_RUN, WINDOW = 20, 20
DIGIT, DIGITS = 5, 12  # bits of a count, and counts in a number
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+"
PIECE = rf"[A-Za-z0-9]{{{MIN_RUN},}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes in order, with the least entropy of a window that counts; runs of no class are prose.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_=-]+$", 3.8),
)
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # a UUID
    r"(?i)^sha(1|256|384|512)[-_=]",  # a labelled digest
    r"(?i)example|placeholder|dummy|changeme|x{6,}",
    r"^(.{1,4})\1+$",  # a short piece repeated
    r"(?i)^(0123456789|abcdefghij)",
)


def _spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches whose group is long enough.

    The pieces between the matches come from a split by the same pattern, so positions are sums of lengths.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        here = F.struct(start.alias("start"), end.alias("end"), x["all"].alias("value"))
        return F.struct(end.alias("at"), *gather(acc, here, F.length(x["part"]) >= least))

    first = F.struct(F.lit(0).alias("at"), *(x.alias(n) for n, x in gathering("struct<start:int,end:int,value:string>").items()))
    found = F.aggregate(F.filter(zipped, lambda x: x["all"].isNotNull()), first, step, gathered)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _nlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def window_spans(value: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct<first, last>: starts of the first and last windows whose entropy reaches the threshold, from 0; null if none."""
    chars = F.split(value, "")
    if window >= 1 << DIGIT:
        raise ValueError("a count has to fit its digit")
    zero = F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // DIGITS + 1)
    word, digit = lambda k: F.floor(k / DIGITS).cast("int"), lambda k: (k % DIGITS * DIGIT).cast("int")
    count = lambda counts, k: F.call_function("shiftright", F.get(counts, word(k)), digit(k)).bitwiseAND((1 << DIGIT) - 1)
    one = lambda k, j: F.when(j == word(k), F.call_function("shiftleft", F.lit(1).cast("long"), digit(k))).otherwise(0)
    most = F.log2(F.lit(float(window)))

    def step(acc, i):
        enters = F.instr(F.lit(ALPHABET), F.element_at(acc["chars"], i))
        leaves = F.when(i > window, F.instr(F.lit(ALPHABET), F.element_at(acc["chars"], F.greatest(i - window, F.lit(1)))))
        # counts by place in the alphabet; 0 stands for no character
        out = F.coalesce(leaves, F.lit(0))
        less = count(acc["counts"], out)
        more = count(acc["counts"], enters) - F.when(enters == out, 1).otherwise(0)
        total = acc["sum"] - F.when(out > 0, _nlog(less) - _nlog(less - 1)).otherwise(0.0) + _nlog(more + 1) - _nlog(more)
        counts = F.transform(acc["counts"], lambda c, j: c + one(enters, j) - F.when(out > 0, one(out, j)).otherwise(0))
        hit = (i >= window) & (most - total / window >= acc["least"] - 1e-9)
        return F.struct(
            acc["chars"].alias("chars"),
            acc["least"].alias("least"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hit & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
            F.when(hit, i - window).otherwise(acc["last"]).alias("last"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(chars.alias("chars"), threshold.cast("double").alias("least"), zero.alias("counts"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _threshold(value: Column) -> Column:
    return reduce(lambda rest, c: F.when(value.rlike(c[1]), F.lit(c[2])).otherwise(rest), reversed(CLASSES), F.lit(None).cast("double"))


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, pieces: bool = False) -> DataFrame:
    """doc_id, base, entropy: arrays of struct<start, kind (its place), name, end, value>, by start. pieces: look at the pieces between separators, too."""
    text = F.col("_text")
    rows = docs.select("doc_id", text_of().alias("_text"))
    for name, pattern, group, least in KINDS:
        rows = rows.withColumn(f"_{name}", _spans(text, pattern, group, least))
    rows = rows.withColumn("_runs", _spans(text, CANDIDATE)).drop("_text")
    named = lambda col, kind, name: F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(name).alias("name"), x["value"].alias("value")))
    base = F.array_sort(F.concat(*(named(F.col(f"_{k[0]}"), i, k[0]) for i, k in enumerate(KINDS))))
    fine = lambda v, patterns=allowed: ~reduce(lambda a, b: a | b, (v.rlike(p) for p in patterns), F.lit(False))
    if pieces:
        anchored = tuple(p for p in allowed if p.removeprefix("(?i)").startswith("^"))
        parted = F.filter("_runs", lambda x: x["value"].rlike("[+/_=-]") & x["value"].rlike(PIECE) & fine(x["value"], anchored))
        moved = lambda x: F.transform(_spans(x["value"], PIECE), lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["value"].alias("value")))
        rows = rows.withColumn("_runs", F.concat("_runs", F.flatten(F.transform(parted, moved))))
    classed = F.filter(F.transform("_runs", lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), _threshold(x["value"]).alias("least"))), lambda x: x["least"].isNotNull() & fine(x["value"]))
    rows = rows.select("doc_id", base.alias("base"), classed.alias("_classed"))
    slid = F.transform("_classed", lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), window_spans(x["value"], x["least"]).alias("w")))
    rows = rows.select("doc_id", "base", slid.alias("_slid"))
    kept = F.transform(
        F.filter("_slid", lambda x: x["w"]["first"].isNotNull()),
        lambda x: F.struct(
            (x["start"] + x["w"]["first"]).alias("start"),
            F.lit(len(KINDS)).alias("kind"),
            (x["start"] + x["w"]["last"] + WINDOW).alias("end"),
            F.lit("entropy").alias("name"),
            F.substring(x["value"], x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"] + WINDOW).alias("value"),
        ),
    )
    rows = rows.select("doc_id", "base", kept.alias("_entropy"))
    apart = F.filter("_entropy", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    rows = rows.select("doc_id", "base", apart.alias("entropy"))
    if not pieces:
        return rows
    # a piece's span inside its run's span tells nothing new
    inside = lambda e, o: (o["start"] <= e["start"]) & (e["end"] <= o["end"]) & (o["end"] - o["start"] > e["end"] - e["start"])
    alone = F.filter(F.array_distinct("entropy"), lambda e: ~F.exists("entropy", lambda o: inside(e, o)))
    return rows.select("doc_id", "base", F.array_sort(alone).alias("entropy"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces=True)
    count = lambda name: F.size(F.filter("base", lambda x: x["name"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id",
        *(count(k[0]) for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
