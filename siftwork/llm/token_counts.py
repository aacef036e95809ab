"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

For a BPE vocabulary each prefix of a word has one encoding, and it is the encoding of a shorter prefix followed by
one token that may stand next to that prefix's last token. So a pass over the word's ends, which stores the last token
and the count of each, gives the exact count at every prefix without encoding any of them. Words (pre-tokens) repeat,
so each worker keeps the columns of the words it has met, up to CACHE_WORDS words and CACHE_COUNTS counts, and then
starts anew. The query takes totals and the cut at LIMIT from them; prefix_table() gives all prefixes of whole texts.

Prefixes that cut a pre-token in two are handled as the pre-tokenizer would: a white-space run at the end of a prefix
is one pre-token, a cut contraction is two, and a cut special token is ordinary text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

LIMIT = 512
CACHE_WORDS = 500_000
CACHE_COUNTS = 10_000_000  # of all columns that a worker keeps, as words may be long
NEVER = 1 << 60
#: The white space of the pre-tokenizer: Unicode's White_Space.
WS = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Code points whose classes all versions of Unicode share; texts with others are split by the library itself.
SETTLED_RANGES = (range(0x250), range(0x2000, 0x2070), range(0x20AC, 0x20AD))


def _class(kind: str) -> str:
    """A character class of the settled code points of a general category."""
    return "".join(rf"\u{c:04X}" for r in SETTLED_RANGES for c in r if unicodedata.category(chr(c))[0] == kind)


#: The pre-tokenizer's pattern, over settled code points.
PATTERN = rf" ?[{_class('L')}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('N')}]+| ?[^{WS}{_class('L')}{_class('N')}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
SETTLED = re.compile("[" + "".join(rf"\u{r[0]:04X}-\u{r[-1]:04X}" for r in SETTLED_RANGES) + "]*+")
SPACES = re.compile(f"[{WS}]*+")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter(dict):
    """Maps a pre-token to its token count, computing what is missing and keeping its column, the counts at all its prefixes; see also column() and counts()."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.tokens = {v: k for k, v in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = re.compile(PATTERN).findall
        self.library = Tokenizer.from_file(path)
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.columns: dict[str, array] = {}
        self.kept = 0
        self.made = {a + b: (i, (a, b)) for (a, b), i in self.ranks.items()}

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces that stand at the token's left (0) or right (1) end while it is built, each with the rank of the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, piece = [], NEVER, token
            while True:
                known.append((piece, until))
                if len(piece) == 1:
                    break
                until, halves = self.made[piece]
                piece = halves[side]
            self.edges[side][token] = known
        return known

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when they stand side by side: no two pieces that meet there while they are built merge.

        Of merges of one rank, the one further left goes first: so left's own wins a tie, and right's own loses it.
        """
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            ranks, other = self.ranks, self._edge(right, 0)
            known = True
            for a, ends in self._edge(left, 1):
                for b, until in other:
                    rank = ranks.get((a, b))
                    if rank is not None and rank < ends and rank <= until:
                        known = False
            self.beside[left, right] = known
        return known

    def byte_column(self, word: bytes) -> list[int]:
        """The count at each byte prefix of one pre-token."""
        n, ids, longest, beside = len(word), self.ids, self.longest, self.beside
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                token = word[j:i]
                if token in ids:
                    fits = j == 0 or beside.get((last[j], token))
                    if fits or fits is None and self._fits(last[j], token):
                        last[i], count[i] = token, count[j] + 1
                        break
        return count

    def column(self, word: str) -> list[int]:
        """The count at each code-point prefix of one pre-token, from 1 code point on, as if the text ended there."""
        n = self[word]
        return [*self.columns.get(word, ()), n]

    def _inner(self, word: str, at: list[int]) -> array:
        """The column of a pre-token but for its last count; at: the counts at its byte prefixes."""
        if word in CONTRACTIONS:
            return array("i", [1, 2][: len(word) - 1])
        return array("i", at[1:-1] if word.isascii() else [at[e] for e in accumulate(len(c.encode()) for c in word[:-1])])

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS or self.kept > CACHE_COUNTS:
            self.clear()
            self.columns.clear()
            self.kept = 0
        at = self.byte_column(word.encode())
        if len(word) > 1:
            self.columns[word] = self._inner(word, at)
            self.kept += len(word)
        n = self[word] = at[-1]
        return n

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or SETTLED.fullmatch(text):
            return self.split(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def segments(self, text: str) -> list[tuple[str, str]]:
        """The text's parts between special tokens, each with the special token that ends it ('' for the last)."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [(text, "")]
        out, at = [], 0
        for m in self.special_split.finditer(text):
            out.append((text[at : m.start()], m[0]))
            at = m.end()
        return [*out, (text[at:], "")]

    def total(self, text: str) -> int:
        """The count at the last prefix."""
        return sum(sum(map(self.__getitem__, self.words(part))) + bool(end) for part, end in self.segments(text))

    def _part(self, words: list[str], base: int, before: str = "") -> list[int]:
        """Counts at each prefix of successive pre-tokens; before: the pre-token ahead of them."""
        out = []
        for word in words:
            column = self.column(word)
            if before and SPACES.fullmatch(before) and SPACES.match(word[0]).end():
                # the prefix ends in a white-space run, which would be one pre-token
                column = [self[before + word[0]] - self[before], *column[1:]]
            out += [base + c for c in column]
            base += self[word]
            before = word
        return out

    def counts(self, text: str) -> np.ndarray:
        """The count at every prefix: element i is for the first i code points."""
        out, base = [0], 0
        for part, end in self.segments(text):
            words = self.words(part)
            out += self._part(words, base)
            base += sum(map(self.__getitem__, words))
            if end:
                cut = part + end[:-1]
                inside = self._part(self.words(cut), out[len(out) - 1 - len(part)])
                out += inside[len(part) :]
                base += 1
                out.append(base)
        return np.array(out, np.int32)

    def fit(self, text: str, limit: int) -> tuple[int, int]:
        """The count at the last prefix, and the most code points whose count is within limit; for these only the pre-tokens about the cut are looked at."""
        parts = self.segments(text)
        if len(parts) > 1:
            counts = self.counts(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= limit)[-1])
        words = self.words(text)
        each = list(map(self.__getitem__, words))
        total = sum(each)
        if total <= limit:
            return total, len(text)
        ends, cut = [0], 0
        while ends[-1] + each[cut] <= limit:
            ends.append(ends[-1] + each[cut])
            cut += 1  # in the end the pre-token that passes the limit
        first = max(0, cut - 1)
        about = self._part(words[first : cut + 2], ends[first], words[first - 1] if first else "")
        start = sum(map(len, words[:first]))
        return total, start + max([i + 1 for i, c in enumerate(about) if c <= limit], default=0)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits: the code points of the longest prefix within limit tokens. path: the vocabulary's, else that of name on each worker."""

    def run(batches):
        by = counter(path or vocabulary(name))
        for b in batches:
            found = [by.fit(t, limit) for t in b.column("text").to_pylist()]
            n, fits = [k for k, _ in found], [k for _, k in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fits"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fits long")


def prefix_table(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """doc_id, counts: the token count at every code-point prefix, 0 first. at_prefix() and fitting() answer from it."""

    def run(batches):
        by = counter(path or vocabulary(name))
        for b in batches:
            counts = pa.array([by.counts(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts], ["doc_id", "counts"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def at_prefix(table: DataFrame, chars: int) -> DataFrame:
    """doc_id, n_tokens of the first chars code points."""
    return table.select("doc_id", F.element_at("counts", F.least(F.lit(chars), F.size("counts") - 1) + 1).alias("n_tokens"))


def fitting(table: DataFrame, limit: int) -> DataFrame:
    """doc_id, chars: the most code points within limit tokens."""
    within = F.transform("counts", lambda c, i: F.when(c <= limit, i))
    return table.select("doc_id", F.array_max(within).alias("chars"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    rows = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("fits").alias("prefix_chars_within_limit"))
