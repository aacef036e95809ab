"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is described by averages over its words (length, upper
case, symbols, digits, repeats, distinct words, and signed hashes of the words) and encoded as h = tanh(W x + b). The
gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) over a document's passages weights them, and the weighted
sum is scored by a logistic unit. All weights are learned together from document labels by Adam, on FIT_ROWS labelled
documents at most, of FIT_BYTES bytes in all (those with the least hashes of their ids: a bounded sample by documented
parameters). Every
passage of every text is encoded and scored.

Defined results: a null text, and one without words, scores the share of label 1 among the learned rows (add-one); so
does every text if the learned rows have one label only or there are none; labels without a quality or a document are
passed over, and repeated labels of a document count once, with the least quality; of rows with a repeated id, that of the
least encoding is learned; very long texts have all their passages encoded; repeated rows and null ids give a
row each (a null id counts as the empty text in the split); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, small_batches, text_of

PASSAGE, HASHED, HIDDEN, GATE = 64, 16, 24, 12
FIT_ROWS, STEPS, RATE, DECAY = 4000, 400, 0.02, 1e-4
FIT_BYTES = 64 << 20
CUT = 0.3
#: Word features: what a regular expression counts in a word, divided by its length.
COUNTED = (r"[A-Z\x{C0}-\x{DE}]", r"[0-9]", r"[|#$%&*!<>{}=+~^@_\\/]", r"[.,;:?]", r"[^\x00-\x7F]")


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages of each text, and the features of all passages."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
    words = words.filter(pa.array(filled))
    counts = np.diff(offsets)
    n = -(-counts // PASSAGE)
    if not len(words):
        return n, np.zeros((0, len(COUNTED) + 6 + HASHED), np.float32)
    coded = words.dictionary_encode()
    d, ids = coded.dictionary, coded.indices.to_numpy()
    length = pc.utf8_length(d).to_numpy().astype(np.float32)
    cols = [np.minimum(length, 40) / 10, (length <= 3).astype(np.float32)]
    cols += [pc.count_substring_regex(d, p).to_numpy().astype(np.float32) / length for p in COUNTED]
    hashes = pd.util.hash_array(np.array(pc.utf8_lower(d).to_pylist(), object), categorize=False)
    bucket = np.zeros((len(d), HASHED), np.float32)
    bucket[np.arange(len(d)), (hashes & np.uint64(HASHED - 1)).astype(np.int64)] = np.where(hashes >> np.uint64(63), 1, -1)
    of_word = np.concatenate([np.stack(cols, 1), bucket], 1)
    # where passages begin: every PASSAGE words from each text's start
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(ids)) - offsets[text]
    first = np.flatnonzero(within % PASSAGE == 0)
    size = np.diff(np.append(first, len(ids))).astype(np.float32)
    passage = np.repeat(np.arange(len(first)), size.astype(np.int64))
    h = hashes[ids]
    again = np.concatenate([[False], h[1:] == h[:-1]]) & (within > 0)
    order = np.lexsort((h, passage))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    distinct = np.bincount(passage[order][new], minlength=len(first))
    mean = np.add.reduceat(of_word[ids], first, axis=0) / size[:, None]
    spread = np.add.reduceat(cols[0][ids] ** 2, first) / size - mean[:, 0] ** 2
    extra = np.stack([np.sqrt(np.maximum(spread, 0)), np.add.reduceat(again.astype(np.float32), first) / size, distinct / size, np.log1p(size) / 4], 1)
    return n, np.concatenate([mean, extra], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """The network; forward() over passages that belong to bags of n each (at least 1)."""

    NAMES = ("W", "b", "V", "U", "w", "c", "c0")

    def __init__(self, wide: int, prior: float = 0.5, seed: int = 11):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale, self.prior, self.fitted = np.zeros(wide, np.float32), np.ones(wide, np.float32), prior, False
        self.p = {"W": init(wide, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "c0": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, first = self.p, np.cumsum(n) - n
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, t, g, a, z, _sigmoid(z @ p["c"] + p["c0"])

    def slopes(self, state: tuple, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(n) - n
        x, h, t, g, a, z, out = state
        d = ((out - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Bags:
        self.mean, self.scale, self.fitted = x.mean(0), x.std(0) + 1e-3, True
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            for k, s in self.slopes(self.forward(x, n), n, y).items():
                s = s + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.999 * second[k] + 0.001 * s * s
                self.p[k] = (self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        n, x = passages(texts)
        out = np.full(len(n), self.prior)
        if self.fitted and len(x):
            out[n > 0] = self.forward(x, n[n > 0])[-1]
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = FIT_ROWS) -> Bags:
    """A model of labels.quality from the labelled rows of docs that learn marks, most of them at most."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # in that order, texts as long as they have FIT_BYTES bytes in all; the window is over most rows
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).alias("bytes")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "quality").agg(F.sum("bytes").alias("bytes"))
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= FIT_BYTES).select("doc_id", "quality")

    def encode(batches):
        for b in batches:
            n, x = passages(b.column("text"))
            cuts = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x[i : i + k].tobytes() for i, k in zip(cuts, n)], pa.binary())], ["doc_id", "quality", "x"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int"))), "doc_id")
    found = sorted(tuple(r) for r in rows.mapInArrow(encode, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x")).collect())  # most rows
    wide = len(COUNTED) + 6 + HASHED
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, wide) for r in found]
    y = np.array([r[1] for r in found], np.float32)
    model = Bags(wide, float((y.sum() + 1) / (len(y) + 2)))
    filled = np.array([len(b) > 0 for b in bags], bool)
    if len(set(y[filled].tolist())) < 2:
        return model
    return model.fit(np.concatenate(bags), np.array([len(b) for b in bags if len(b)]), y[filled])


def scored(docs: DataFrame, model: Bags) -> DataFrame:
    """doc (a struct of all columns of docs) and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            doc = b.column("doc")
            scores = sent.value.score(pc.struct_field(doc, [place]))
            yield pa.RecordBatch.from_arrays([doc, pa.array(scores, pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_crc() % 5 != 0)
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc.doc_id", (id_crc("doc.doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
