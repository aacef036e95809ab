"""Packs documents into windows by minimum bin slack: a bitset subset-sum picks the lengths that fill each window closest.

A document's tokens and one end token are cut at every WINDOW tokens. So there are at most WINDOW lengths, however many
documents, and their counts are what the plan is made of: while pieces are left, the longest length is set, and a dynamic
program over sums (bit s of an integer: sum s can be had from the lengths so far) finds the multiset of other lengths whose
sum is closest to what is left of the window; going back through the steps gives the count of each length. The same multiset
fills as many windows as its counts allow. So every step uses up a length, or leaves less of it than one window takes,
and the plan's size depends on WINDOW and not on the documents. If more than SLACK tokens stay free while pieces are left,
one more piece is cut to fill them, and its rest goes back to the counts: a corpus of one length is packed closely, too.

Pieces are numbered within their length, by ranges; a piece's number tells its place in the plan. Nothing but the counts by
length reaches the driver. Pieces that the plan cuts (few, if lengths are mixed) are encoded anew for their checksums.

Defined results: a null text counts as empty: one piece, the end token; very long texts are encoded whole, by the task
that reads them; repeated rows and null ids are packed each for itself, and pieces equal in length, id, start and text are
placed in any order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import collections
import functools
import itertools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, hot_join, materialize, numbered, small_batches, text_of, trim
from .token_counts import PrefixCounter, vocabulary

WINDOW, END, VOCABULARY = 2048, 1, "byte_bpe_50k.json"
#: Free tokens in a window up to which no piece is cut to fill them.
SLACK = 8
#: Pre-tokens and bytes of ids that a worker keeps; beyond, it starts anew.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64 << 20
#: Keys of special tokens: a letter beside a digit is no pre-token.
SPECIAL = "\0a0"


class Encoder(PrefixCounter):
    """Ids of texts, as the library for the vocabulary gives them, and END: pre-tokens repeat, so their ids are kept."""

    def __init__(self, path: str):
        super().__init__(path)
        self.fixed = {SPECIAL + s: array("I", [self.library.token_to_id(s)]).tobytes() for s in self.special} | {SPECIAL: array("I", [END]).tobytes()}
        self.known: dict[str, bytes] = dict(self.fixed)
        self.held = 0

    def _units(self, text: str) -> list[str]:
        out = []
        for part, end in self.segments(text):
            out += self.words(part)
            if end:
                out.append(SPECIAL + end)
        out.append(SPECIAL)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each begins, and the last ends."""
        units = list(map(self._units, texts))
        met = pa.array(list(itertools.chain.from_iterable(units)), pa.large_string()).dictionary_encode()
        names, at = met.dictionary.to_numpy(zero_copy_only=False).tolist(), met.indices.to_numpy()
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known, self.held = dict(self.fixed), 0
        each = list(map(self.known.get, names))
        new = [i for i, ids in enumerate(each) if ids is None]
        for i, found in zip(new, self.library.encode_batch_fast([names[i] for i in new], add_special_tokens=False)):
            self.known[names[i]] = each[i] = ids = array("I", found.ids).tobytes()  # of this machine's order; checksums are taken over little-endian ones
            self.held += len(ids)
        flat = np.frombuffer(b"".join(each), np.uint32).astype("<u4", copy=False)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(size) - size
        sizes = size[at]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum([len(u) for u in units]) - 1
        return ids, np.concatenate(([0], ends[last])) if len(units) else np.zeros(1, np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECE = "doc_id long, tag string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, tag (of the text), start, length, ids_crc32, doc_tokens: each document's tokens, cut at every window tokens."""

    def run(batches):
        by = encoder(path or vocabulary(VOCABULARY))
        for b in batches:
            ids, ends = by.encode(b.column("text").to_pylist())
            n = np.diff(ends)
            count = -(-n // window)
            row = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, n[row] - start)
            raw, at = memoryview(ids.tobytes()), (ends[row] + start) * 4
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + length * 4).tolist())]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("tag").take(row), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n).take(row)], ["doc_id", "tag", "start", "length", "ids_crc32", "doc_tokens"])
        trim()

    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(run, PIECE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.md5(text_of()).alias("tag"), text_of().alias("text"))


def fill(counts: dict[int, int], lengths: list[int], window: int) -> dict[int, int]:
    """The multiset of lengths (ascending, those with counts) that holds the longest one and comes closest to window."""
    longest = lengths[-1]
    room = window - longest
    reach, goal, within, steps = 1, 1 << room, (1 << room + 1) - 1, []
    for x in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        left, some = min(counts[x] - (x == longest), room // x), 1
        while left > 0:  # 1, 2, 4, ... and the rest of them: any number is a sum of these
            some = min(some, left)
            more = (reach | reach << x * some) & within
            if more != reach:
                steps.append((reach, x, some))
                reach = more
            left -= some
            some *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, collections.Counter({longest: 1})
    for before, x, some in reversed(steps):
        if not before >> at & 1:
            at -= x * some
            out[x] += some
    return out


class Plan:
    """Where the pieces go, by length and number: rows (length, low, first, count, high, ordinal, windows, sequence, offset).

    A row says: of the pieces of this length numbered first to first + count - 1, tokens low to high - 1 go to windows
    sequence + j mod windows, at offset + (j div windows) * (high - low), j counting on from ordinal.
    """

    def __init__(self, counts: dict[int, int], window: int = WINDOW, slack: int = SLACK):
        self.rows: list[tuple[int, ...]] = []
        self.sequences, self.cuts = 0, 0
        #: by length: what is left, as [whole length, first number, count, low]
        self.pool = {x: collections.deque([[x, 0, n, 0]]) for x, n in counts.items() if n}
        self.left = {x: n for x, n in counts.items() if n}
        self.lengths = sorted(self.left)
        while self.lengths:
            self._step(window, slack)

    def _take(self, x: int, n: int):
        """n pieces of length x from the pool: (whole length, first number, count, low)."""
        self.left[x] -= n
        if not self.left[x]:
            del self.left[x]
            self.lengths.remove(x)
        while n:
            whole, first, count, low = self.pool[x][0]
            some = min(n, count)
            yield whole, first, some, low
            n -= some
            if some == count:
                self.pool[x].popleft()
            else:
                self.pool[x][0] = [whole, first + some, count - some, low]

    def _put(self, x: int, whole: int, first: int, count: int, low: int) -> None:
        if x not in self.left:
            self.left[x] = 0
            bisect.insort(self.lengths, x)
            self.pool[x] = collections.deque()
        self.left[x] += count
        self.pool[x].append([whole, first, count, low])

    def _step(self, window: int, slack: int) -> None:
        chosen = fill(self.left, self.lengths, window)
        free = window - sum(x * n for x, n in chosen.items())
        # what is left is longer than the free tokens, or it would have been chosen
        cut = next((x for x in reversed(self.lengths) if self.left[x] > chosen[x]), None) if free > slack else None
        need = collections.Counter(chosen)
        if cut:
            need[cut] += 1
        windows = min(self.left[x] // n for x, n in need.items())
        offset = 0
        for x, n in chosen.items():
            ordinal = 0
            for whole, first, count, low in self._take(x, n * windows):
                self.rows.append((whole, low, first, count, low + x, ordinal, windows, self.sequences, offset))
                ordinal += count
            offset += x * n
        if cut:
            ordinal = 0
            for whole, first, count, low in list(self._take(cut, windows)):
                self.rows.append((whole, low, first, count, low + free, ordinal, windows, self.sequences, offset))
                self._put(cut - free, whole, first, count, low + free)
                ordinal += count
            self.cuts += windows
        self.sequences += windows


#: A piece's length, the token it is cut at and its number, as one number.
LOW_BITS, NUMBER_BITS = 12, 38


def _key(length, low, number):
    return (length << LOW_BITS + NUMBER_BITS) | (low << NUMBER_BITS) | number


def assigned(parts: DataFrame, window: int = WINDOW, slack: int = SLACK) -> tuple[DataFrame, Plan]:
    """Written pieces with sequence_id and offset, and the plan; ids_crc32 is null where the plan cuts a piece."""
    assert window < 1 << LOW_BITS
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most window rows
    plan = Plan(counts, window, slack)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 9)
    keys = _key(table[:, 0], table[:, 1], table[:, 2])

    def run(batches):
        for b in batches:
            row, low = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            length, number = b.column("length").to_numpy(), b.column("place").to_numpy()
            out = []
            while len(row):
                found = table[np.searchsorted(keys, _key(length[row], low, number[row]), "right") - 1]
                _, _, first, _, high, ordinal, windows, sequence, offset = found.T
                j = ordinal + number[row] - first
                out.append((row, low, high, sequence + j % windows, offset + j // windows * (high - low)))
                on = high < length[row]
                row, low = row[on], high[on]
            row, low, high, sequence, offset = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 5
            whole = high - low == length[row]
            at = pa.array(row)
            start = b.column("start").to_numpy()[row] + low
            crc = pa.array(b.column("ids_crc32").to_numpy()[row], mask=~whole)
            columns = [b.column("doc_id").take(at), b.column("tag").take(at), pa.array(start), pa.array(high - low), crc, b.column("doc_tokens").take(at), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = numbered(parts, ["length"], ["doc_id", "start", "tag"])
    return rows.mapInArrow(run, f"{PIECE}, sequence_id long, offset long"), plan


def slices(docs: DataFrame, wanted: DataFrame, path: str | None = None) -> DataFrame:
    """wanted (tag, start, length: each once; other columns stay) with ids (little-endian unsigned 32-bit) and ids_crc32 of the texts of docs.

    Only the texts that are wanted are shuffled, each once, however often it repeats.
    """

    def run(batches):
        by = encoder(path or vocabulary(VOCABULARY))
        for b in batches:
            ids, ends = by.encode(b.column("text").to_pylist())
            raw, lists = memoryview(ids.tobytes()), b.column("wanted")
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            at = (ends[row] + start) * 4
            cut = [bytes(raw[a:z]) for a, z in zip(at.tolist(), (at + length * 4).tolist())]
            columns = [b.column("tag").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(cut, pa.binary()), pa.array(map(zlib.crc32, cut), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["tag", "start", "length", "ids", "ids_crc32"])
        trim()

    small_batches(docs.sparkSession)
    # a text has at most as many different slices as the plan has rows of its pieces' lengths
    lists = materialize(wanted.groupBy("tag").agg(F.collect_list(F.struct("start", "length")).alias("wanted")))
    texts = by_bucket(_texts(docs).drop("doc_id"), F.col("tag"), lists, F.col("tag")).groupBy("tag").agg(F.first("text").alias("text"))
    return texts.join(lists, "tag").mapInArrow(run, "tag string, start long, length long, ids binary, ids_crc32 long")


def _sliced(docs: DataFrame, rows: DataFrame, column: str, path: str | None) -> DataFrame:
    """Written rows (tag, start, length) with a column of their slices; slices of a text that fills many rows are broadcast."""
    rows = rows.withColumn("_cut", F.concat_ws(":", "tag", "start", "length"))
    wanted = materialize(rows.groupBy("_cut", "tag", "start", "length").agg(F.count(F.lit(1)).alias("_weight")))
    found = slices(docs, wanted, path).select(F.concat_ws(":", "tag", "start", "length").alias("_cut"), column)
    found = materialize(wanted.select("_cut", "_weight").join(found, "_cut"))
    return hot_join(rows, found, "_cut", "_weight", rows.count()).drop("_cut", "_weight")


def packed(docs: DataFrame, window: int = WINDOW, slack: int = SLACK, path: str | None = None) -> DataFrame:
    """doc_id, tag, start, length, ids_crc32, doc_tokens, sequence_id, offset: all tokens of docs, each in one piece."""
    rows, plan = assigned(materialize(pieces(docs, window, path)), window, slack)
    if not plan.cuts:
        return rows
    rows = materialize(rows)
    cut = _sliced(docs, rows.filter("ids_crc32 IS NULL").drop("ids_crc32"), "ids_crc32", path)
    return rows.filter("ids_crc32 IS NOT NULL").unionByName(cut.select(rows.columns))


def sequences(docs: DataFrame, window: int = WINDOW, slack: int = SLACK, pad: int = 0, path: str | None = None) -> DataFrame:
    """sequence_id, ids (array, padded to window but at a power of two), documents (array of doc_id, start, length, offset)."""
    filled = _sliced(docs, materialize(packed(docs, window, slack, path)), "ids", path)

    def run(batches):
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                out.append(ids if len(ids).bit_count() == 1 else np.pad(ids, (0, window - len(ids)), constant_values=pad))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(out, pa.list_(pa.int64())), b.column("documents")], ["sequence_id", "ids", "documents"])

    part = F.struct("offset", "ids", "doc_id", "start", "length")
    groups = filled.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a window's tokens at most
    documents = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset")))
    kind = "array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint>>"
    return groups.withColumn("documents", documents).mapInArrow(run, f"sequence_id long, ids array<bigint>, documents {kind}")


def op13_packing(spark, sf_dir: str) -> DataFrame:
    rows = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
