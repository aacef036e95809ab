"""Similar names for many queries at once, and a persisted index of trigrams for searches inside names.

similar_pairs() joins queries with names by scalars.similarity(). A name carries 64 bits of its characters, with and without
separators, and of its trigrams: each element sets one, so the bits that one text has and another has not bound from above what
they share. Pairs that pass by lengths and bits are verified by the measure itself.

Up to FEW queries (counted) are sent to the tasks, and every name meets all of them by its bits, where it is. More are joined
with names without comparing all of them. A pair that reaches the threshold t does so by one of five ways, and each has
signatures of which such a pair shares one:

* edit distance, over the texts in lower case and over these without separators: texts of m characters at most that differ
  by d edits share m - d of their characters, counted with repeats; so a pair at t shares t * m of them. Of each text's
  characters (the k-th occurrence of a character is one element), the rarest len - ceil(t * len) + 2 make its prefix, and two
  prefixes share two elements; a signature is a pair of elements and a band of lengths. Two texts of up to two characters
  share one element at least; texts of more than LONG characters have single elements as signatures.
* containment without separators, of lengths within a factor of 0.4: the longer text has the shorter one's rarest trigram;
  a shorter text of one or two characters is itself the signature.
* the Dice measure of trigrams: sets of a and b trigrams share t * (a + b) / 2, so of each set the rarest
  a - ceil(t / (2 - t) * a) + 1 make its prefix, and two prefixes share a trigram.
* nothing but separators: texts of such equal each other but for these, and share one signature.

Elements are ordered by their counts in names. A pair is verified once.

Defined results: a null name or query, and an empty one, is similar to nothing; repeated ones count once; very long ones are
compared whole; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import best_similarity, edit_similarity, like_contains
from ..sources.files import written
from .search import LEAST_SIMILARITY, RESULTS, SUGGESTIONS

#: The least share of lengths at which containment counts; what does not count in a bare name.
CONTAINED, SEPARATORS = 0.4, r"(?U)[_\-\s]"
EPS = 1e-9
#: Scores are rounded to six places, so a pair may lie so much below the threshold.
ROUNDED = 6e-7
#: Queries, and their bytes in all, that are sent to the tasks.
FEW, FEW_BYTES = 2000, 4_000_000


def _elements(x: Column) -> Column:
    """The characters of a text, each with how many equal ones come before it."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    # the place of a character in the sorted array, less the place of the first equal one; as the only element of an array it is sorted once
    placed = lambda s: F.transform(s, lambda c, i: F.concat(c, (i + 1 - F.array_position(s, c)).cast("string")))
    return F.flatten(F.transform(F.array(F.sort_array(chars)), placed))


def _grams(x: Column, n: int = 3) -> Column:
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _forms(rows: DataFrame) -> DataFrame:
    """name, low, bare of the distinct names."""
    low = F.lower("name")
    rows = rows.select("name").filter(F.col("name") != "").distinct()
    return rows.select("name", low.alias("low"), F.regexp_replace(low, SEPARATORS, "").alias("bare"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Few bytes, but long work on each: dealt to all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bits(xs: Column) -> Column:
    """64 bits, of which each element sets one."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(xs, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(one(x)))


def _marked(forms: DataFrame, as_: str) -> DataFrame:
    """as_ (the name), and as_low, as_bare, as_grams with their bits and sizes."""
    rows = forms.select("name", "low", "bare", _grams(F.col("low")).alias("grams"))
    bits = [_bits(_elements(F.col(x))).alias(f"{as_}_{x}_bits") for x in ("low", "bare")] + [_bits(F.col("grams")).alias(f"{as_}_grams_bits")]
    sizes = [F.length(x).alias(f"{as_}_{x}_size") for x in ("low", "bare")] + [F.size("grams").alias(f"{as_}_grams_size")]
    return rows.select(F.col("name").alias(as_), *(F.col(x).alias(f"{as_}_{x}") for x in ("low", "bare", "grams")), *bits, *sizes)


def _ordered(forms: DataFrame, of: Column, counts: DataFrame) -> DataFrame:
    """name, xs: the elements of a name, the rarest of counts (x, n) first."""
    rows = forms.select("name", F.explode(of).alias("x")).join(counts, "x", "left")
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))), lambda s: s["x"]).alias("xs"))


def _counts(forms: DataFrame, of: Column) -> DataFrame:
    return written(forms.select(F.explode(of).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")))


def _band(n: Column, t: float) -> Column:
    """Texts of a pair at t are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / t) + EPS).cast("int")


#: Characters beyond which a text's signatures are single elements, as it has too many pairs of them.
LONG = 64


def _hashed(rows: DataFrame, kind: str) -> DataFrame:
    """name, sig of rows (name, s): an array of signatures of a kind."""
    return rows.select("name", F.explode("s").alias("s")).select("name", F.xxhash64(F.lit(kind), "s").alias("sig"))


def _edit_signatures(forms: DataFrame, form: str, counts: DataFrame, t: float, asked: bool) -> DataFrame:
    rows = _ordered(forms, _elements(F.col(form)), counts).withColumn("len", F.size("xs"))
    prefix = lambda more: F.slice("xs", F.lit(1), (F.col("len") - F.ceil(F.col("len") * t - EPS) + more).cast("int"))
    rows = rows.withColumn("p", F.when(F.col("len") <= LONG, prefix(2)))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.concat(a, F.lit(" "), b))))
    none = F.array().cast("array<string>")
    single = F.when(F.col("len") <= 2, F.transform("xs", lambda a: F.concat(F.lit("one "), a))).otherwise(none)
    # a long text meets long ones, and those that are long enough for it, by one element
    named = lambda word: F.transform(prefix(1), lambda a: F.concat(F.lit(word), a))
    mine, other = ("long query ", "long name ") if asked else ("long name ", "long query ")
    long = F.when(F.col("len") > LONG, F.concat(named("long "), named(mine))).when(F.col("len") > LONG * t - 1, named(other)).otherwise(none)
    signatures = F.concat(F.coalesce(pairs, none), single, long)
    band = F.explode(F.array(*(_band(F.col("len"), t) + b for b in ((-1, 0, 1) if asked else (0,)))))
    return _hashed(rows.select("name", signatures.alias("s"), band.alias("band")).select("name", F.transform("s", lambda x: F.concat(F.col("band").cast("string"), F.lit(" "), x)).alias("s")), form)


def _dice_signatures(forms: DataFrame, counts: DataFrame, t: float) -> DataFrame:
    rows = _ordered(forms, _grams(F.col("low")), counts)
    n = F.size("xs")
    return _hashed(rows.select("name", F.slice("xs", F.lit(1), (n - F.ceil(n * (t / (2 - t)) - EPS) + 1).cast("int")).alias("s")), "dice")


def _inside_signatures(forms: DataFrame, counts: DataFrame, shorter: str, longer: str) -> DataFrame:
    """Of a name as the shorter text, under one word, and as the longer one, under the other."""
    bare = F.col("bare")
    rarest = _ordered(forms.filter(F.length(bare) >= 3), _grams(bare), counts).select("name", F.get("xs", F.lit(0)).alias("x"))
    short = rarest.unionByName(forms.filter(F.length(bare).between(1, 2)).select("name", bare.alias("x")))
    few = F.when(F.length(bare) <= int(2 / CONTAINED), F.concat(_grams(bare, 1), _grams(bare, 2))).otherwise(F.array().cast("array<string>"))
    long = forms.select("name", F.explode(F.concat(_grams(bare), few)).alias("x"))
    return short.select("name", F.xxhash64(F.lit(shorter), "x").alias("sig")).unionByName(long.select("name", F.xxhash64(F.lit(longer), "x").alias("sig")))


def _pairs(queries: DataFrame, names: DataFrame, least: float, few: int) -> DataFrame:
    """Distinct pairs of marked queries and names: all that are similar by least, and others."""
    t = least - ROUNDED
    if not (1 / 3 < t and least <= 1):
        raise ValueError("signatures need a threshold above 1/3")
    asked, known = written(_forms(queries)), _dealt(_forms(names))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    if n <= few and size <= FEW_BYTES:
        return _marked(known, "name").crossJoin(F.broadcast(_marked(asked, "query")))
    known = written(known)
    return _sharing(asked, known, t).join(_marked(asked, "query"), "query").join(_marked(known, "name"), "name")


def _sharing(asked: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """Distinct query, name that share a signature: all pairs at t, and others."""
    counts = {form: _counts(known, _elements(F.col(form))) for form in ("low", "bare")}
    grams = {form: _counts(known, _grams(F.col(form))) for form in ("low", "bare")}

    def signatures(forms: DataFrame, is_query: bool, *roles: str) -> DataFrame:
        parts = [_edit_signatures(forms, form, counts[form], t, is_query) for form in ("low", "bare")]
        parts += [_dice_signatures(forms, grams["low"], t), _inside_signatures(forms, grams["bare"], *roles)]
        parts.append(_hashed(forms.filter("bare = ''").select("name", F.array(F.lit("")).alias("s")), "none"))
        return reduce(DataFrame.unionByName, parts).distinct()

    left = signatures(asked, True, "in name", "in query").withColumnRenamed("name", "query")
    right = signatures(known, False, "in query", "in name")
    return left.join(right, "sig").select("query", "name").distinct()


def _score(least: float) -> Column:
    """similarity() of a pair of _pairs() if it is least or more, else at most that: a measure is taken only if sizes and bits leave it possible."""
    t = least - ROUNDED

    def sides(form: str) -> tuple[Column, ...]:
        a, b, x, y = (F.col(f"{side}_{form}_{what}") for what in ("size", "bits") for side in ("query", "name"))
        # an element that sets a bit which the other text has not is not shared
        alone = lambda m, n: F.bit_count(m.bitwiseAND(F.bitwise_not(n)))
        return F.col(f"query_{form}"), F.col(f"name_{form}"), a, b, F.least(a - alone(x, y), b - alone(y, x))

    def near(form: str) -> Column:
        x, y, a, b, shared = sides(form)
        # none shares more than the shorter text has
        return F.when(shared >= F.greatest(a, b) * t - EPS, edit_similarity(x, y)).otherwise(F.lit(0.0))

    x, y, a, b, shared = sides("grams")
    alike = F.when((a > 0) & (b > 0) & (2.0 * shared >= t * (a + b) - EPS), 2.0 * F.size(F.array_intersect(x, y)) / (a + b)).otherwise(F.lit(0.0))
    forms = (F.col(f"{side}_{form}") for form in ("low", "bare") for side in ("query", "name"))
    return best_similarity(*forms, near("low"), near("bare"), alike)


def candidates(queries: DataFrame, names: DataFrame, least: float = LEAST_SIMILARITY, few: int = FEW) -> DataFrame:
    """Distinct query, name (of both: name) of which a measure is taken: all that are similar by least, which is above 1/3, and others."""
    return _pairs(queries, names, least, few).filter(_score(least) > 0).select("query", "name")


def similar_pairs(queries: DataFrame, names: DataFrame, least: float = LEAST_SIMILARITY, few: int = FEW) -> DataFrame:
    """query, name, score of all pairs of distinct queries and names whose similarity, to six places, is least or more."""
    # exploded, a score is told once a pair; a filter would be moved into the join with a copy of it, and methods of two copies are too long for the JVM to compile
    scored = _pairs(queries, names, least, few).select("query", "name", F.explode(F.array(F.round(_score(least), 6))).alias("score"))
    return scored.filter(F.col("score") >= least)


def fuzzy_many(symbols: DataFrame, queries: DataFrame, most: int = RESULTS) -> DataFrame:
    """search.fuzzy() for every query (name): query, place and the columns of symbols, score."""
    pairs = similar_pairs(queries, symbols)
    # no query shows more places than most, so of a name only its first ones can count
    in_name = F.row_number().over(Window.partitionBy("name").orderBy("file_path", "line"))
    places = symbols.dropDuplicates(["file_path", "name", "line"]).withColumn("_k", in_name).filter(F.col("_k") <= most).drop("_k")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file_path", "line", "name"))
    return pairs.join(places, "name").withColumn("place", place).filter(F.col("place") <= most)


def suggest_many(symbols: DataFrame, queries: DataFrame, least: float = 0.4, most: int = SUGGESTIONS) -> DataFrame:
    """search.suggest() for every query (name): query, file_path, name, score, place."""
    pairs = similar_pairs(queries, symbols, least)
    rows = pairs.join(symbols.select("file_path", "name").distinct(), "name")
    place = F.row_number().over(Window.partitionBy("query", "file_path").orderBy(F.desc("score"), "name"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("query", "file_path", "name", "score", "place")


# --- an index of trigrams -----------------------------------------------------------------------------------------

BUCKETS = 64


def bucket(x: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")


def write_index(symbols: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes symbols by buckets of their names, the names by buckets of their trigrams (in lower case), and the count of each trigram."""
    names = written(symbols.select("name").filter("name IS NOT NULL").distinct())
    posted = names.select("name", F.explode(_grams(F.lower("name"))).alias("gram")).withColumn("bucket", bucket("gram", buckets))
    # one file a bucket, its rows by trigram, so row groups of other trigrams are passed over, too
    posted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "name").write.partitionBy("bucket").parquet(f"{path}/postings")
    grams = posted.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("names"))
    grams.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")
    placed = symbols.withColumn("bucket", bucket("name", buckets))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "name").write.partitionBy("bucket").parquet(f"{path}/symbols")


class NameIndex:
    """A written index: searches read the files of one trigram, and of the names found."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.postings, self.grams, self.symbols = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "grams", "symbols"))

    def _bucket_of(self, values: list[str]) -> dict[str, int]:
        """The buckets of given values: of a query's few trigrams, not of data."""
        rows = self.spark.createDataFrame([(v,) for v in values], "x string").select("x", bucket("x", self.buckets).alias("b")).collect()
        return {r["x"]: r["b"] for r in rows}

    def names(self, needle: str) -> DataFrame | None:
        """The names that hold needle, in any case; None if it is too short to have a trigram."""
        low = self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not grams:
            return None
        of = self._bucket_of(grams)
        asked = self.grams.filter(F.col("bucket").isin(*set(of.values())) & F.col("gram").isin(*grams))
        found = {r["gram"]: r["names"] for r in asked.select("gram", "names").collect()}  # a row a trigram of the needle
        rarest = min(grams, key=lambda g: (found.get(g, 0), g))
        rows = self.postings.filter((F.col("bucket") == of[rarest]) & (F.col("gram") == rarest)).select("name")
        return rows if len(grams) == 1 and len(low) == 3 else rows.filter(like_contains("name", needle))

    def like(self, needle: str, most: int | None = RESULTS) -> DataFrame:
        """search.like() by the index: the same rows. A needle of one or two characters is looked for in all names."""
        names = self.names(needle)
        if names is None:
            rows = self.symbols.filter(like_contains("name", needle)).drop("bucket")
        else:
            hit = names.withColumn("bucket", bucket("name", self.buckets))
            rows = self.symbols.join(hit, ["bucket", "name"], "left_semi").drop("bucket")
        rows = rows.orderBy("file_path", "line", "name")
        return rows if most is None else rows.limit(most)

    def exact(self, name: str, most: int = RESULTS) -> DataFrame:
        b = self._bucket_of([name])[name]
        return self.symbols.filter((F.col("bucket") == b) & (F.col("name") == name)).drop("bucket").orderBy("file_path", "line", "name").limit(most)

    def search(self, query: str, exact_only: bool = False, most: int = RESULTS) -> DataFrame:
        """search.search() by the index; similar names are looked for by their signatures."""
        query = query.strip()
        columns = [c for c in self.symbols.columns if c != "bucket"]
        found = (self.exact if exact_only else self.like)(query, most).select(columns) if query else self.symbols.select(columns).limit(0)
        found = found.withColumn("score", F.lit(1.0)).withColumn("match", F.lit("exact" if exact_only else "like"))
        if not query or not found.isEmpty():
            return found
        asked = self.spark.createDataFrame([(query,)], "name string")
        return fuzzy_many(self.symbols.select(columns), asked, most).withColumn("match", F.lit("fuzzy")).select(found.columns)
