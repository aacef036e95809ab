"""Words and hashed shingle sets of Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * M3
    x = x ^ (x >> np.uint64(32))
    x = x * M3
    return x ^ (x >> np.uint64(32))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words per text and all words, A-Z lower-cased; nulls count as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
        words = words.filter(pa.array(filled))
    return np.diff(offsets), words


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64 bits of each string: its bytes times pseudo-random odd numbers by place, summed and mixed."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1]
    length = np.diff(offsets)
    sums = np.zeros(n, np.uint64)
    if offsets[-1] > offsets[0]:
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        factors = mix(np.arange(1, length.max() + 1, dtype=np.uint64) * M1) | np.uint64(1)
        data += np.uint64(1)
        data *= factors[np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length)]
        filled = length > 0
        sums[filled] = np.add.reduceat(data, (offsets[:-1] - offsets[0])[filled])
    return mix(sums + length.astype(np.uint64) * M2)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return string_hashes(coded.dictionary)[coded.indices.to_numpy()]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's width-word shingles; of fewer words, one hash of them all; of none, an empty set."""
    counts, words = split_words(texts)
    w = word_hashes(words)
    ends = np.cumsum(counts)
    h = np.zeros(len(w), np.uint64)
    for k in range(width):
        part = np.roll(w, -k) if k else w
        h = mix(h * M1 + part + np.uint64(k))
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            s = np.sort(h[end - n : end - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif n:
            one = np.array([n], np.uint64)
            for x in w[end - n : end]:
                one = mix(one * M2 + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
