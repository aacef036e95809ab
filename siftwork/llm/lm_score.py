"""Log-probabilities of texts by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end a text. Counts of all training tokens give the base: add-one unigrams,
unseen words counting as one more type. The model factors p(w | h) = p(class | h) p(w | class, h). The HEAD most
frequent tokens (ties by code point) form classes of WIDTH by rank; all others, unseen words included, form TAILS
classes by a hash of their last two letters. Features of the history h are hashed to ROWS rows each: the word before,
the two before, and the word before that alone (a skip). Inside a head class the word is predicted by the same features,
each with rows of its own for the class. Inside a tail class, where there is no end to the words, the weight of a word
after a hashed word before it follows from counts of all training pairs: if words of the class followed C times, this one
c times, p = (c + k q) / (C + k), where q is the word's add-one share of the class and k = PRIOR * C ** POWER. These counts
grow with the corpus; all words of a class, unseen ones as one, sum to 1. Without weights and counts the model is the
unigram model.

Training goes over every training text once, in ROUNDS synchronous rounds, over slices by a hash of id and text. In a
round each task sums, over its texts, how often each feature met each outcome and how often the model at hand expects
it; the difference, summed over all tasks, is the gradient, and each weight takes one step along it, scaled by the mean
of both sums (a diagonal estimate of the curvature) plus DAMP. The first round's expectations are known beforehand. So a
round does not depend on how texts lie in files or tasks, but for the order of floating-point sums. Weights have a fixed
size; only they, the counts behind C and the head's words reach the driver.

Histories repeat, so texts are worked on GROUP tokens at once: the softmax is computed once a distinct history, and once
a distinct history and head class, in sparse batches of PIECE rows.

Scoring adds class and head terms while it reads a text. Tail tokens are dealt by a hash of their word, so all the
counts of a word meet in one part, whose task adds up what it tells of each text; the sums go back to the text's chunk.
A tail word has at most one in HEAD + 1 of all tokens, and words of more than PART tokens, whose counts are broadcast, are
dealt by the word before them, too. Words and the words before them are told apart by 64 and 13 bits of hashes.

Defined results: a null text counts as empty, whose only token is the end; rows with null ids count by the empty id;
repeated rows and ties are counted and scored each; a very long text may be one chunk on its own; an empty table gives an
empty result, and one without training rows gives each token the one unseen type; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize, small_batches, text_of, trim
from .shingles import M1, M2, mix, split_words, string_hashes

HEAD, WIDTH, TAILS = 1024, 32, 32
HEADS = HEAD // WIDTH
CLASSES = HEADS + TAILS
ROWS = 8192  # of each feature table: 13 bits
FEATURES = 3  # of the class, and of the word in a head class
#: Slices of the training texts, and how many of them each round goes over; the steps of the first and of later rounds.
SLICES, ROUNDS = 12, (4, 2, 2, 2, 2)
FIRST, STEP, DAMP, MOST = 0.7, 0.4, 3.0, 15.0
CONTEXTS, PRIOR, POWER = 1 << 16, 4.0, 0.7  # hashed words before a tail word
GROUP, PIECE = 250_000, 8192
SHORT = 16  # rows that are summed a step at a time
COUNTED = 1_500_000  # tokens that a task counts at once
BLOCKS = 64
#: Tokens that a training task sums at least, and tasks of a round at most: each of them sends its sums once.
TRAIN_TOKENS, TRAIN_TASKS = 4_000_000, 20_000
#: Tail tokens and texts of a chunk, tail tokens of a part, and words that are split at most.
CHUNK, CHUNK_TEXTS, PART, SPLIT_WORDS = 1_000_000, 1 << 15, 1_000_000, 100_000
START, END = np.uint64(0x51AF), np.uint64(0xE4D)


class Vocabulary:
    """What every task knows of the words: the head's ranks and counts, and the totals of classes."""

    def __init__(self, head: list[tuple[str, int]], tail: dict[int, int], tokens: int, types: int):
        self.head = [w for w, _ in head]
        counts = np.zeros(HEAD)
        counts[: len(head)] = [c for _, c in head]
        self.tokens, self.log_all = tokens, math.log10(tokens + types + 1)
        self.head_log = np.log10(counts + 1)
        mass = np.where(np.arange(HEAD) < len(head), counts + 1, 1e-9)
        self.tail_mass = np.array([tail.get(i, 0) + 1 for i in range(TAILS)], float)
        by_class = np.concatenate([mass.reshape(-1, WIDTH).sum(1), self.tail_mass])
        self.class_share = by_class / by_class.sum()
        self.word_share = mass.reshape(-1, WIDTH) / mass.reshape(-1, WIDTH).sum(1, keepdims=True)
        self.class_bias, self.word_bias = (np.log(x).astype(np.float32) for x in (self.class_share, self.word_share))


def _tails(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    return np.array([zlib.crc32(x.encode()) % TAILS for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Group:
    """The tokens of some texts, ends included, in order of their history and class; histories and their features."""

    def __init__(self, texts: pa.Array, v: Vocabulary):
        counts, words = split_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary if len(words) else pa.array([], pa.string())
        size = len(distinct)
        ids = coded.indices.to_numpy() if len(words) else np.zeros(0, np.int32)
        known = pa.array(v.head, pa.string())
        ranks = pc.fill_null(pc.index_in(pa.concat_arrays([distinct, pa.array([""], pa.string())]), known), -1).to_numpy().astype(np.int64)
        # after all words come the end and the start, which stands before the first word
        self.hashes = np.append(string_hashes(distinct), np.array([END, START]))
        symbols = np.where(ranks >= 0, ranks, HEAD + np.append(_tails(distinct), np.int64(zlib.crc32(b"") % TAILS))).astype(np.int32)
        self.n = counts + 1
        stop = np.cumsum(self.n)
        first = stop - self.n
        word = np.full(len(ids) + len(counts), size, np.int32)
        inside = np.ones(len(word), bool)
        inside[stop - 1] = False
        word[inside] = ids
        one, two = np.empty_like(word), np.empty_like(word)
        one[1:], two[2:] = word[:-1], word[:-2]
        one[first], two[first] = size + 1, size + 1
        two[(first + 1)[self.n > 1]] = size + 1
        symbol = symbols[word]
        cls = np.where(symbol < HEAD, symbol // WIDTH, symbol - HEAD + HEADS)
        at = lambda x: (x >> np.uint64(51)).astype(np.uint16)  # 13 bits: ROWS
        before = mix(self.hashes * M1)
        near = at(before)
        # words in order of their row, so that runs of a row lie together
        by_row = np.argsort(near, kind="stable").astype(np.int32)
        place = np.empty(size + 2, np.int64)
        place[by_row] = np.arange(size + 2)
        key = (place[one] * (size + 2) + two) * CLASSES + cls
        self.order = np.argsort(key)
        key = key[self.order]
        self.text = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[self.order]
        self.word, self.cls, self.symbol = word[self.order], cls[self.order], symbol[self.order]
        # runs of one history and class; histories
        self.run = _starts(key)
        self.run_n = np.diff(np.append(self.run, len(key)))
        self.run_cls = self.cls[self.run]
        history = key[self.run] // CLASSES
        self.first_run = _starts(history)
        self.run_history = np.repeat(np.arange(len(self.first_run)), np.diff(np.append(self.first_run, len(history))))
        h_one, h_two = one[self.order][self.run][self.first_run], two[self.order][self.run][self.first_run]
        pair = (self.hashes * M2)[h_one] + mix(self.hashes)[h_two]
        pair ^= pair >> np.uint64(29)
        pair *= M1
        self.context = (before >> np.uint64(48)).astype(np.uint16)[h_one]  # 16 bits: CONTEXTS
        self.features = [near[h_one], at(pair), at(mix(self.hashes * M2))[h_two]]

    def history_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.repeat(self.run_history, self.run_n)[tokens]

    def pieces(self):
        """Histories i to j, their runs and the tokens of these."""
        for i in range(0, len(self.first_run), PIECE):
            j = min(i + PIECE, len(self.first_run))
            a = self.first_run[i]
            b = self.first_run[j] if j < len(self.first_run) else len(self.run)
            yield i, j, a, b, self.run[a], self.run[b] if b < len(self.run) else len(self.order)


def _in_class(features: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    """A feature inside a class has a row of its own."""
    return [((f.astype(np.uint32) * np.uint32(2654435761) + cls.astype(np.uint32) * np.uint32(40503 * 65537)) >> np.uint32(19)).astype(np.uint16) for f in features]


class Model:
    """Weights: FEATURES tables of ROWS x CLASSES for the class, and of ROWS x WIDTH for the word in a head class."""

    def __init__(self, classes: np.ndarray | None = None, words: np.ndarray | None = None):
        self.classes = np.zeros((FEATURES * ROWS, CLASSES), np.float32) if classes is None else classes
        self.words = np.zeros((FEATURES * ROWS, WIDTH), np.float32) if words is None else words

    @staticmethod
    def _softmax(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials, and the sums of these; weights are small enough for float32."""
        x = table[:ROWS].take(rows[0], axis=0, mode="clip")
        for k in range(1, FEATURES):
            x += table[k * ROWS : (k + 1) * ROWS].take(rows[k], axis=0, mode="clip")
        x += bias
        e = np.exp(x)
        return x, e, e @ np.ones(e.shape[1], np.float32)

    def piece(self, g: Group, v: Vocabulary, i: int, j: int, a: int, b: int):
        """The softmax of the histories i to j over classes; and of their runs in head classes over words, with their places."""
        f = [x[i:j] for x in g.features]
        classes = self._softmax(self.classes, f, v.class_bias)
        heads = np.flatnonzero(g.run_cls[a:b] < HEADS)
        cls, at = g.run_cls[a:b][heads], g.run_history[a:b][heads] - i
        rows = _in_class([x[at] for x in f], cls)
        words = self._softmax(self.words, rows, v.word_bias[cls])
        return f, classes, heads, rows, words

    def score(self, g: Group, v: Vocabulary) -> np.ndarray:
        """Of each text, the sum of log10 p(class | h) of its tokens, and of head tokens also of log10 p(word | class, h)."""
        out = np.zeros(len(g.n))
        for i, j, a, b, s, t in g.pieces():
            _, (x, _, z), heads, _, (y, _, zy) = self.piece(g, v, i, j, a, b)
            history = g.run_history[a:b] - i
            of_run = x[history, g.run_cls[a:b]].astype(np.float64) - np.log(z)[history]
            log = np.repeat(of_run, g.run_n[a:b])
            if len(heads):
                n = g.run_n[a:b][heads]
                inside = np.zeros(b - a, np.int64)
                inside[heads] = np.arange(len(heads))
                tokens = np.flatnonzero(g.cls[s:t] < HEADS)
                row = np.repeat(np.arange(len(heads)), n)
                log[tokens] += y[row, g.symbol[s:t][tokens] % WIDTH].astype(np.float64) - np.log(zy)[row]
            out += np.bincount(g.text[s:t], log, len(out))
        return out / math.log(10)


def _sums(x: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows order[first : first + n] of x, the longest runs first: long ones one by one, short ones all together, a row of each a step."""
    g = x.take(order[first], axis=0, mode="clip")
    long = int(np.searchsorted(-n, -SHORT))
    for i in range(long):
        g[i] = np.ones(n[i], np.float32) @ x.take(order[first[i] : first[i] + n[i]], axis=0, mode="clip")
    for j in range(1, SHORT):
        some = int(np.searchsorted(-n, -j))
        if some <= long:
            break
        g[long:some] += x.take(order[first[long:some] + j], axis=0, mode="clip")
    return g


#: Tables: weights of the class, weights of the word in a head class, and counts of words before tail classes.
SHAPES = ((FEATURES * ROWS, CLASSES), (FEATURES * ROWS, WIDTH), (CONTEXTS, TAILS))


class Sums:
    """How often features met outcomes, and how often a model expects it, in tables like its weights; and counts of words before tail classes."""

    def __init__(self, model: Model | None):
        """model: None for weights of 0, whose expectations follow from the counts."""
        self.model = model
        self.met = [np.zeros(shape, np.int32) for shape in SHAPES]
        self.expected = [np.zeros(shape, np.float32) for shape in SHAPES[:2]]

    @staticmethod
    def _add(table: np.ndarray, k: int, rows: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = _starts(sorted_rows)
        n = np.diff(np.append(first, len(rows)))
        longest = np.argsort(-n, kind="stable")
        first, n = first[longest], n[longest]
        table[sorted_rows[first].astype(np.int64) + k * ROWS] += _sums(x, order, first, n)

    def add(self, g: Group, v: Vocabulary) -> None:
        run_rows = [x[g.run_history].astype(np.int64) for x in g.features]
        for k, f in enumerate(run_rows):
            self.met[0][k * ROWS : (k + 1) * ROWS] += np.bincount(f * CLASSES + g.run_cls, g.run_n, ROWS * CLASSES).reshape(ROWS, CLASSES).astype(np.int32)
        heads = np.flatnonzero(g.cls < HEADS)
        run_of = np.repeat(np.arange(len(g.run)), g.run_n)[heads]
        inside = _in_class([x[g.run_history] for x in g.features], g.run_cls)
        for k, f in enumerate(inside):
            self.met[1][k * ROWS : (k + 1) * ROWS] += np.bincount(f[run_of].astype(np.int64) * WIDTH + g.symbol[heads] % WIDTH, None, ROWS * WIDTH).reshape(ROWS, WIDTH).astype(np.int32)
        tails = np.flatnonzero(g.run_cls >= HEADS)
        before = g.context[g.run_history[tails]].astype(np.int64) * TAILS + g.run_cls[tails] - HEADS
        cells, of = np.unique(before, return_inverse=True)
        self.met[2].reshape(-1)[cells] += np.bincount(of, g.run_n[tails], len(cells)).astype(np.int32)
        if self.model is None:
            some = np.flatnonzero(g.run_cls < HEADS)
            for k, f in enumerate(inside):
                by = np.bincount(f[some].astype(np.int64) * HEADS + g.run_cls[some], g.run_n[some], ROWS * HEADS).reshape(ROWS, HEADS)
                self.expected[1][k * ROWS : (k + 1) * ROWS] += (by @ v.word_share).astype(np.float32)
            return
        for i, j, a, b, _, _ in g.pieces():
            f, (_, e, z), heads, rows, (_, ey, zy) = self.model.piece(g, v, i, j, a, b)
            n = np.add.reduceat(g.run_n[a:b], g.first_run[i:j] - a)
            e *= (n / z).astype(np.float32)[:, None]
            for k in range(FEATURES):
                self._add(self.expected[0], k, f[k], e)
            if len(heads):
                ey *= (g.run_n[a:b][heads] / zy).astype(np.float32)[:, None]
                for k in range(FEATURES):
                    self._add(self.expected[1], k, rows[k], ey)

    def finished(self, v: Vocabulary) -> None:
        if self.model is None:
            self.expected[0] += (self.met[0].sum(1, keepdims=True) * v.class_share).astype(np.float32)


def change(met: np.ndarray, expected: np.ndarray, step: float) -> np.ndarray:
    """The step of each weight: the gradient over the mean of both sums."""
    return step * (met - expected) / ((met + expected) / 2 + DAMP)


def _count(batches):
    """held_out, text -> word, c: of training words, counted together over many batches (the end is the empty word); and as null all tokens."""
    held, tokens, ends, every = [], 0, 0, 0

    def rows():
        found = pc.value_counts(pa.concat_arrays([*held, pa.array([], pa.string())]))
        words, counts = found.field("values"), found.field("counts")
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(["", None], pa.string())]), pa.concat_arrays([counts, pa.array([ends, every], pa.int64())])], ["word", "c"])

    for b in batches:
        training = pc.invert(b.column("held_out"))
        n, words = split_words(b.column("text").filter(training))
        held.append(words)
        tokens, ends = tokens + len(words), ends + len(n)
        every += len(words) + b.num_rows + int(split_words(b.column("text").filter(b.column("held_out")))[0].sum())
        if tokens > COUNTED:
            yield rows()
            held, tokens, ends, every = [], 0, 0, 0
    if every:
        yield rows()


def _grouped(batches, columns: tuple[str, ...] = ()):
    """Texts of successive batches together, of about GROUP tokens; and columns of them."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column("text").nbytes // 7 + b.num_rows
        if size >= GROUP:
            yield _together(held, columns)
            held, size = [], 0
            trim()
    if held:
        yield _together(held, columns)
        held = None
    trim()


def _together(held, columns):
    return [pa.concat_arrays([b.column(c) for b in held]) for c in ("text", *columns)]


def _rows(block: int) -> slice:
    size = SHAPES[block // BLOCKS][0] // BLOCKS
    return slice(block % BLOCKS * size, (block % BLOCKS + 1) * size)


def _summed(vocabulary, model):
    """Texts -> (block, payload): counts, and expectations of the tables that have weights. model: None in the first round."""

    def run(batches):
        v = vocabulary.value
        sums = Sums(Model(*model.value) if model else None)
        for (texts,) in _grouped(batches):
            sums.add(Group(texts, v), v)
        sums.finished(v)
        for block in range(3 * BLOCKS):
            which, rows = block // BLOCKS, _rows(block)
            if sums.met[which][rows].any():
                expected = sums.expected[which][rows].tobytes() if which < 2 else b""
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.met[which][rows].tobytes() + expected], pa.binary())], ["block", "payload"])

    return run


def _stepped(step: float):
    """All payloads of a block, one after the other -> one payload: the step of its weights, or the sum of its counts."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
                which, rows = block // BLOCKS, _rows(block)
                shape = (rows.stop - rows.start, SHAPES[which][1])
                size = shape[0] * shape[1]
                # counts stay whole numbers, as they grow with the corpus
                both = sums.setdefault(block, np.zeros((2, *shape)) if which < 2 else np.zeros((1, *shape), np.int64))
                both[0] += np.frombuffer(payload, np.int32, size).reshape(shape)
                if which < 2:
                    both[1] += np.frombuffer(payload, np.float32, size, 4 * size).reshape(shape)
        for block, both in sums.items():
            out = change(*both, step).astype(np.float32) if len(both) > 1 else both[0]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "payload"])

    return run


def train(texts: DataFrame, vocabulary) -> tuple[Model, np.ndarray]:
    """The weights, and the counts of words before tail classes. texts: slice (0 to SLICES - 1), text. vocabulary: broadcast."""
    context, model, contexts, done = texts.sparkSession.sparkContext, Model(), np.zeros(SHAPES[2], np.int64), 0
    for r, share in enumerate(ROUNDS):
        sent = context.broadcast((model.classes, model.words)) if r else None
        tasks = min(TRAIN_TASKS, math.ceil(vocabulary.value.tokens * share / SLICES / TRAIN_TOKENS) or 1)
        mine = texts.filter(F.col("slice").between(done, done + share - 1)).select("text").coalesce(tasks)
        summed = mine.mapInArrow(_summed(vocabulary, sent), "block int, payload binary")
        steps = summed.repartition(min(BLOCKS, 4 * tasks), "block").mapInArrow(_stepped(STEP if r else FIRST), "block int, payload binary")
        for block, payload in steps.collect():  # of fixed size: the weights and the counts
            table, rows = (model.classes, model.words, contexts)[block // BLOCKS], _rows(block)
            table[rows] += np.frombuffer(payload, table.dtype).reshape(-1, table.shape[1])
        for table in (model.classes, model.words):
            np.clip(table, -MOST, MOST, out=table)
        done += share
        if sent:
            sent.destroy()
        trim()
    return model, contexts


ROUTED = "part int, chunk long, kind int, blob binary"
TAIL, TEXTS = 0, 1  # kinds of blobs


def _routed(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["part", "chunk", "kind", "blob"])


def _scored(vocabulary, model, split, parts: int):
    """Texts -> for each chunk, its tail tokens in blobs by part, and what its texts have by themselves in one blob."""

    def run(batches):
        v, m, split_keys, task = vocabulary.value, Model(*model.value), split.value[0], TaskContext.get().partitionId()
        tokens, texts, part, size, count = [], [], 0, 0, 0

        def flushed():
            chunk = (task << 32) + part
            key, cls, ctx, doc = (np.concatenate(x) for x in zip(*tokens))
            deal = key
            if len(split_keys):
                deal = np.where(np.isin(key, split_keys), mix(key + ctx.astype(np.uint64) * M1), key)
            order = np.argsort(deal)
            key, cls, ctx, doc, deal = key[order], cls[order], ctx[order], doc[order], deal[order]
            to = (((deal >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
            cuts = _starts(to)
            for i, j in zip(cuts, np.append(cuts[1:], len(to))):
                runs = _starts(deal[i:j])
                n = np.diff(np.append(runs, j - i)).astype(np.uint32)
                blob = b"".join(x.tobytes() for x in (np.array([len(runs), j - i], np.int64), key[i:j][runs], n, ctx[i:j], doc[i:j], cls[i:j][runs]))
                yield _routed([(int(to[i]), chunk, TAIL, blob)])
            table = pa.concat_tables(texts).combine_chunks().to_batches()[0]
            yield _routed([(chunk % parts, chunk, TEXTS, table.serialize().to_pybytes())])

        for some, doc_id, held_out in _grouped(batches, ("doc_id", "held_out")):
            for a in range(0, len(some), CHUNK_TEXTS):
                at = slice(a, a + CHUNK_TEXTS)
                if texts and (size >= CHUNK or count + len(some[at]) > CHUNK_TEXTS):
                    yield from flushed()
                    tokens, texts, part, size, count = [], [], part + 1, 0, 0
                g = Group(some[at], v)
                tail = np.flatnonzero(g.cls >= HEADS)
                head = np.flatnonzero(g.cls < HEADS)
                learned = ~held_out[at].to_numpy(zero_copy_only=False)
                doc = ((g.text[tail] + count).astype(np.uint16) << np.uint16(1)) | learned[g.text[tail]].astype(np.uint16)
                tokens.append((g.hashes[g.word[tail]], (g.cls[tail] - HEADS).astype(np.uint8), g.context[g.history_of(tail)], doc))
                size, count = size + len(tail), count + len(g.n)
                alone = (doc_id[at], held_out[at], g.n, np.bincount(g.text[head], minlength=len(g.n)), np.bincount(g.text[head], v.head_log[g.symbol[head]], len(g.n)), m.score(g, v))
                texts.append(pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(alone, TEXT_SCHEMA)], schema=TEXT_SCHEMA))
        if texts:
            yield from flushed()

    return run


class Part:
    """The tail tokens of a part: of each text of each chunk, how many are known, and the sums of log10(count + 1) and of log10 p(word | class, h)."""

    def __init__(self, blobs: list[bytes]):
        read = [self._read(x) for x in blobs]
        keys, n, ctx, doc, cls = (np.concatenate(x) for x in zip(*read))
        self.blob = np.repeat(np.arange(len(blobs)), [len(x[2]) for x in read])
        self.keys, first, of_run = np.unique(keys, return_index=True, return_inverse=True)
        self.cls, self.word = cls[first], np.repeat(of_run, n)
        self.ctx, self.doc, self.learned = ctx.astype(np.int64), doc >> 1, (doc & 1).astype(np.float64)

    @staticmethod
    def _read(blob: bytes):
        runs, tokens = np.frombuffer(blob, np.int64, 2).tolist()
        out, at = [], 16
        for kind, size in ((np.uint64, runs), (np.uint32, runs), (np.uint16, tokens), (np.uint16, tokens), (np.uint8, runs)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += out[-1].nbytes
        return out

    def told(self, v: Vocabulary, contexts: np.ndarray, priors: np.ndarray, split: tuple[np.ndarray, np.ndarray]):
        """Rows (blob, texts, known, logs, p)."""
        count = np.bincount(self.word, self.learned, len(self.keys))
        if len(split[0]):
            at = np.minimum(np.searchsorted(split[0], self.keys), len(split[0]) - 1)
            count = np.where(split[0][at] == self.keys, split[1][at], count)
        share = (count + 1) / v.tail_mass[self.cls]
        pair = self.word * CONTEXTS + self.ctx
        order = np.argsort(pair)
        first = _starts(pair[order])
        met = np.empty(len(pair))
        met[order] = np.repeat(np.add.reduceat(self.learned[order], first), np.diff(np.append(first, len(pair))))
        at = self.ctx * TAILS + self.cls[self.word]
        prior = priors[at]
        p = np.log10((met + prior * share[self.word]) / (contexts[at] + prior))
        texts, of = np.unique(self.blob * CHUNK_TEXTS + self.doc, return_inverse=True)
        sums = [np.bincount(of, x, len(texts)) for x in ((count > 0).astype(float)[self.word], np.log10(count + 1)[self.word], p)]
        blob = texts // CHUNK_TEXTS
        for i, j in zip(cuts := _starts(blob), np.append(cuts[1:], len(blob))):
            yield int(blob[i]), (texts[i:j] % CHUNK_TEXTS).astype(np.uint16), sums[0][i:j].astype(np.uint32), sums[1][i:j], sums[2][i:j].astype(np.float32)


def _told(vocabulary, counted, split):
    """Rows (part, chunk, kind, blob), sorted by part -> rows for the chunks."""

    def run(batches):
        v, contexts = vocabulary.value, counted.value.ravel().astype(np.float64)
        priors = PRIOR * np.maximum(contexts, 1) ** POWER
        now, chunks, blobs = None, [], []

        def rows():
            for i, *values in Part(blobs).told(v, contexts, priors, split.value):
                blob = b"".join(x.tobytes() for x in (np.array([len(values[0])], np.int64), *values))
                yield _routed([(0, chunks[i], TAIL, blob)])

        for b in batches:
            for part, chunk, kind, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                if kind == TEXTS:
                    yield _routed([(0, chunk, TEXTS, blob)])
                    continue
                if part != now and blobs:
                    yield from rows()
                    chunks, blobs = [], []
                    trim()
                now = part
                chunks.append(chunk)
                blobs.append(blob)
        if blobs:
            yield from rows()
        blobs = None
        trim()

    return run


FINISHED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _finished(batches):
    """Rows of chunks, sorted by chunk and kind: what the parts tell of its texts, then the texts."""
    sums, now = np.zeros((3, CHUNK_TEXTS)), None
    for b in batches:
        for _, chunk, kind, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
            if chunk != now:
                sums[:], now = 0, chunk
            if kind == TAIL:
                n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
                values = []
                for t in (np.uint16, np.uint32, np.float64, np.float32):
                    values.append(np.frombuffer(blob, t, n, at))
                    at += values[-1].nbytes
                for k in range(3):
                    sums[k, values[0]] += values[k + 1]
                continue
            texts = pa.ipc.read_record_batch(pa.py_buffer(blob), TEXT_SCHEMA)
            n = texts.num_rows
            added = lambda name, k, kind: pa.array((texts.column(name).to_numpy() + sums[k, :n]).astype(kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("held_out"), texts.column("n"), added("known", 0, np.int64), added("logs", 1, float), added("score", 2, float)], [x.split()[0] for x in FINISHED.split(", ")])


TEXT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text). held_out: rows not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of().alias("text"))
    counts = materialize(rows.select("held_out", "text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    every = counts.filter("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = counts.filter("word IS NOT NULL AND c > 0")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = [tuple(r) for r in counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()]  # HEAD rows
    tail = counts.join(F.broadcast(spark.createDataFrame([(w,) for w, _ in head], "word string")), "word", "left_anti")
    totals = tail.groupBy(F.pmod(F.crc32(F.right("word", F.lit(2))), F.lit(TAILS)).cast("int").alias("t")).agg((F.sum("c") + F.count(F.lit(1))).alias("m"))
    context = spark.sparkContext
    vocabulary = context.broadcast(Vocabulary(head, {t: m for t, m in totals.collect()}, tokens, types))  # TAILS rows
    often = tail.filter(F.col("c") > max(PART, tokens // SPLIT_WORDS)).collect()  # SPLIT_WORDS rows at most
    keys = string_hashes(pa.array([r["word"] for r in often], pa.string()))
    by_key = np.argsort(keys)
    split = context.broadcast((keys[by_key], np.array([r["c"] for r in often], float)[by_key]))
    slices = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
    model, contexts = train(rows.filter("NOT held_out").select(slices.alias("slice"), "text"), vocabulary)
    sent, counted = context.broadcast((model.classes, model.words)), context.broadcast(contexts)
    parts = max(1, -(-every // PART))
    scored = rows.mapInArrow(_scored(vocabulary, sent, split, parts), ROUTED)
    told = scored.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_told(vocabulary, counted, split), ROUTED)
    done = told.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_finished, FINISHED)
    base = F.col("logs") - F.col("n_tokens") * F.lit(vocabulary.value.log_all)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), id_crc() % 7 == 2)
