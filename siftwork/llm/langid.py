"""Language of texts by a blended-spectrum string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's spectrum is the set of its byte n-grams of ORDERS, over lower-cased text in which each run of ASCII characters
other than letters is one space; n-grams are hashed to SPACE_BITS bits. The kernel of two texts is the size of the
common spectrum over the root of the product of their sizes. Landmarks are texts of the learned rows; with K their
kernel matrix, the features of a text are its kernel values with the landmarks times K^(-1/2), and ridge regression on
these gives one margin a language. Batches of presence rows are multiplied by the landmarks' and then by the weights.

Fitting uses about FIT_EACH texts of each language (those whose hash of the id is low enough for its counted rows), of
which LANDMARKS of each language are landmarks: a bounded sample by documented parameters.

Defined results: a null text and one without letters is `und` with score 0, and so is every text if no row can be
learned from; ties go to the language first by code point; very long texts are read whole; repeated rows and null ids give a row each (a null id
counts as the empty text in the split); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, small_batches, text_of

ORDERS, SPACE_BITS = (1, 2, 3), 14
FIT_EACH, LANDMARKS, RIDGE, SHARP = 300, 32, 1e-2, 4.0
ROWS = 128  # multiplied at once

LETTERS = np.full(256, 32, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[128:] = np.arange(128, 256)


def spectrum(text: bytes) -> np.ndarray:
    """Places of the text's n-grams, repeats included."""
    b = LETTERS[np.frombuffer(text, np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])] if len(b) else b
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(b) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(2654435761)) >> np.uint32(32 - SPACE_BITS))
    return np.concatenate(out)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text, divided by the root of its sum."""
    x = np.zeros((len(texts), 1 << SPACE_BITS), np.float32)
    for row, t in zip(x, texts):
        row[spectrum(t.encode())] = 1
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _packed(batches):
    """Texts -> their presence rows, a bit each."""
    for b in batches:
        rows = []
        for t in b.column("t").to_pylist():
            row = np.zeros(1 << SPACE_BITS, bool)
            row[spectrum(t.encode())] = True
            rows.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array(rows, pa.binary())], ["lang", "place", "bits"])


class Kernel:
    def __init__(self, rows: np.ndarray, langs: list[str]):
        """rows: those of presence() of the learned texts."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        # landmarks in turn from each language
        turn = {g: 0 for g in self.langs}
        rank = []
        for i, g in enumerate(langs):
            rank.append((turn[g], g, i))
            turn[g] += 1
        marks = [i for t, _, i in sorted(rank) if t < LANDMARKS]
        self.landmarks = rows[marks]
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        features = (rows @ self.landmarks.T).astype(np.float64) @ root
        features = np.concatenate([features, np.ones((len(rows), 1))], 1)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        # every language weighs the same
        weight = np.sqrt(np.array([1 / turn[g] for g in langs]) * len(langs) / len(self.langs))[:, None]
        left = (features * weight).T @ (features * weight) + RIDGE * np.eye(features.shape[1])
        solved = np.linalg.solve(left, (features * weight).T @ (y * weight))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), ROWS):
            margins = (presence(texts[i : i + ROWS]) @ self.landmarks.T) @ self.weights + self.bias
            e = np.exp(SHARP * (margins - margins.max(1, keepdims=True)))
            best = margins.argmax(1)
            names += [self.langs[k] for k in best]
            scores += (e[np.arange(len(best)), best] / e.sum(1)).tolist()
        return names, scores


HAS_LETTER = r"\p{L}"


def _random() -> Column:
    """A number by id and text, as ids may be null or repeated."""
    return F.xxhash64(F.lit(3), "doc_id", "text")


def fit(docs: DataFrame, learn: Column, each: int = FIT_EACH) -> Kernel:
    """A model of lang from the rows of docs that learn marks."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & text_of().rlike(HAS_LETTER)).select("doc_id", "lang", F.col("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(_random(), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # counts has a row for each language
    some = rows.join(F.broadcast(counts), "lang").filter(share * F.col("n") <= 1.5 * each)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(_random(), "doc_id", "text"))
    chosen = some.withColumn("place", place).filter(F.col("place") <= each).select(F.lower("text").alias("t"), "lang", "place")
    small_batches(docs.sparkSession)
    # each rows a language, of a fixed size, as only the presence of n-grams leaves the workers
    found = sorted(tuple(r) for r in chosen.mapInArrow(_packed, "lang string, place int, bits binary").collect())
    bits = np.array([np.frombuffer(r[2], np.uint8) for r in found], np.uint8).reshape(len(found), (1 << SPACE_BITS) // 8)
    return Kernel(_unit(np.unpackbits(bits, axis=1).astype(np.float32)) if len(found) else np.zeros((0, 1 << SPACE_BITS), np.float32), [r[0] for r in found])


def predicted(docs: DataFrame, model: Kernel, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    text = text_of()
    rows = docs.select("doc_id", held_out.alias("held_out"), F.when(text.rlike(HAS_LETTER), F.lower(text)).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None] if m.langs else []
            if known:
                names[known], scores[known] = m.predict([texts[i] for i in known])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fit(docs, id_crc() % 3 != 1), id_crc() % 3 == 1)
