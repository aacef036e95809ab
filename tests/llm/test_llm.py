"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import decontam, exact_dedup, jaccard_join, langid, lm_score, mixing, quality, queries, secrets, sharding, shingles, token_counts
from siftwork.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, tag long, doc string, _key string, item string, n long, node long, score double, key string, _id long, _id_tag long, _text_tag long, _bad long, _bad_tag long, id_tag long, stays boolean, target double, taken long"
EN, DE = "the cat and the dog of that with this in house", "der hund und die katze von das mit dieser im haus"


def rows_of():
    r = random.Random(8)
    make = lambda words, n: " ".join(r.choice(words.split()) + str(r.randint(0, 30)) for _ in range(n))
    out = [(i, make(EN if i % 2 else DE, r.randint(3, 80)), "en" if i % 2 else "de", ["s1", "s0", None, "s2"][min(i % 7, 3)]) for i in range(120)]
    base = make(EN, 120)
    for i in range(30):  # near copies
        w = base.split()
        w[r.randrange(120)] = f"changed{i}"
        out.append((200 + i, " ".join(w), "en", "s1"))
    out += [(300 + i, base, "en", "s0") for i in range(12)]  # exact copies, and one that differs in white space and case
    out += [(320, base.replace(" ", " \n\t", 3), "en", "s0"), (321, base.upper(), "en", "s0")]
    out += [(400, None, None, None), (401, "", "en", "s1"), (402, " \n\t ", "de", "s1"), (403, "one", None, "s9"), (404, "ONE", "en", None), (405, "two words", "en", "s1"), (None, "no id here at all", "en", "s1"), (None, None, None, None)]
    out += [(406, "é😀漢 " * 50 + "<|endoftext|> it's", "en", "s1"), (407, make(EN, 9000), "en", "s2"), (408, "x" * 40000, "en", "s2"), (409, "!!! 123 ???", "en", "s1")]
    return out + [out[5], out[5]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*x, len(x[1] or ""), 7, 8, 9, "d", "k", "i", 5, 6, 0.5, "q", 77, 78, 79, 80, 81, 82, False, 0.25, 83) for x in rows_of()]
    return spark.createDataFrame(rows, CLASH).repartition(5).cache()


@pytest.fixture(scope="session")
def pdf(docs):
    return docs.select("doc_id", "text").toPandas().astype(object).where(lambda d: d.notna(), None)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


# --- 1 ---


def held(i, m, r):
    return zlib.crc32(b"" if i is None else str(int(i)).encode()) % m == r


def test_lm_base_is_exact_and_model_beats_it(spark, docs, pdf, none):
    got = lm_score.score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).toPandas()
    tokens = [words(t) + [""] for t in pdf["text"]]
    count = collections.Counter(w for i, x in zip(pdf["doc_id"], tokens) if not held(i, 7, 2) for w in x)
    n, v = sum(count.values()), len(count)
    want = sorted((len(x), sum(count[w] > 0 for w in x), held(i, 7, 2), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in zip(pdf["doc_id"], tokens))
    assert sorted(zip(got.n_tokens, got.n_known, got.held_out, got.base_score.round(6))) == want
    assert set(got.train_tokens) == {n} and np.isfinite(got.score).all() and (got.score < 0).all()
    assert got.score.sum() > got.base_score.sum()
    assert lm_score.score_texts(none, F.lit(False)).count() == 0
    all_out = lm_score.score_texts(docs.limit(3), F.lit(True)).collect()  # nothing to learn from
    assert {r["train_tokens"] for r in all_out} == {0} and {r["base_score"] for r in all_out} == {0.0}


def trained(texts, v, rounds):
    """A model after some steps over the same texts, as a round of training makes them."""
    model = lm_score.Model()
    for r in range(rounds):
        sums = lm_score.Sums(model if r else None)
        sums.add(lm_score.Group(pa.array(texts), v), v)
        sums.finished(v)
        for table, met, expected in zip((model.classes, model.words), sums.met, sums.expected):
            table += lm_score.change(met, expected, lm_score.STEP)
    return model


def scores(model, v, texts):
    return model.score(lm_score.Group(pa.array(texts), v), v)


def test_lm_probabilities_sum_to_one():
    head = [(f"w{i}", 100 - i) for i in range(40)] + [("", 30)]
    v = lm_score.Vocabulary(sorted(head, key=lambda x: -x[1]), {3: 50}, 5000, 60)
    r = np.random.default_rng(1)
    m = lm_score.Model(*(r.normal(size=(lm_score.FEATURES * lm_score.ROWS, w)).astype(np.float32) for w in (lm_score.CLASSES, lm_score.WIDTH)))
    g = lm_score.Group(pa.array(["w1 w2 other", "w3", ""]), v)
    for i, j, a, b, _, _ in g.pieces():
        _, (_, e, z), heads, _, (_, ey, zy) = m.piece(g, v, i, j, a, b)
        assert np.allclose(e.sum(1), z, rtol=1e-4) and np.allclose(ey.sum(1), zy, rtol=1e-4) and len(heads)


def test_lm_scores_equal_a_plain_softmax_over_all_words():
    """p(word | h) of every head word and of every tail class, for each history: computed one by one from the weights."""
    head = sorted([(f"w{i}", 100 - i) for i in range(70)] + [("", 30)], key=lambda x: -x[1])
    v = lm_score.Vocabulary(head, {3: 50, 9: 4}, 5000, 160)
    r = np.random.default_rng(2)
    m = lm_score.Model(*(r.normal(size=(lm_score.FEATURES * lm_score.ROWS, w)).astype(np.float32) for w in (lm_score.CLASSES, lm_score.WIDTH)))
    at = lambda x: int(x) >> 51
    hashes = lambda w: lm_score.START if w is None else lm_score.END if w == "" else lm_score.string_hashes(pa.array([w]))[0]
    one = np.ones(1, np.uint64)

    def log10(history, word):
        a, b = (hashes(w) * one for w in history)
        pair = a * lm_score.M2 + lm_score.mix(b)
        pair ^= pair >> np.uint64(29)
        f = [at(lm_score.mix(a * lm_score.M1)[0]), at((pair * lm_score.M1)[0]), at(lm_score.mix(b * lm_score.M2)[0])]
        x = v.class_bias.astype(float) + sum(m.classes[k * lm_score.ROWS + f[k]].astype(float) for k in range(3))
        rank = v.head.index(word) if word in v.head else None
        cls = rank // lm_score.WIDTH if rank is not None else lm_score.HEADS + zlib.crc32(word[-2:].encode()) % lm_score.TAILS
        out = x[cls] - np.log(np.exp(x).sum())
        if rank is not None:
            rows = [int(y[0]) for y in lm_score._in_class([np.array([q], np.uint16) for q in f], np.array([cls]))]
            y = v.word_bias[cls].astype(float) + sum(m.words[k * lm_score.ROWS + rows[k]].astype(float) for k in range(3))
            out += y[rank % lm_score.WIDTH] - np.log(np.exp(y).sum())
        return out / math.log(10)

    texts = ["w1 w2 other w69", "w3 w3 w3", "", "unseen w0"]
    for t, got in zip(texts, scores(m, v, texts)):
        words = [*t.split(), ""]
        before = [None, None, *words]
        assert abs(got - sum(log10((before[i + 1], before[i]), w) for i, w in enumerate(words))) < 1e-4, t
    every = sum(10 ** log10(("w1", "w2"), w) for w in v.head) + sum(10 ** log10(("w1", "w2"), w) for w in {zlib.crc32(f"{a}{b}".encode()) % lm_score.TAILS: f"__{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"}.values())
    assert abs(every - 1) < 1e-4  # a word for each tail class: all words


def test_lm_slopes():
    """The gradient that a round sums is that of the log-likelihood."""
    v = lm_score.Vocabulary([(w, 100) for w in ["x", "a", "b", "c", "d", ""]], {5: 9}, 600, 9)
    texts = ["a x c", "b x d tail", "c c", ""]
    r = np.random.default_rng(4)
    m = lm_score.Model(*(r.normal(size=(lm_score.FEATURES * lm_score.ROWS, w)).astype(np.float32) / 2 for w in (lm_score.CLASSES, lm_score.WIDTH)))
    sums = lm_score.Sums(m)
    sums.add(lm_score.Group(pa.array(texts), v), v)
    for table, met, expected in zip((m.classes, m.words), sums.met, sums.expected):
        slope = met - expected
        for at in [tuple(x) for x in np.argwhere(met > 0)[::4]] + [tuple(x) for x in np.argwhere((met == 0) & (expected > 1e-3))[::40]]:
            keep = table[at]
            table[at] = keep + 0.05
            up = scores(m, v, texts).sum()
            table[at] = keep - 0.05
            down = scores(m, v, texts).sum()
            table[at] = keep
            assert abs((up - down) * math.log(10) / 0.1 - slope[at]) < 5e-3


def test_lm_first_round_expects_what_weights_of_zero_do():
    v = lm_score.Vocabulary([(f"w{i}", 200 - i) for i in range(100)], {5: 9}, 6000, 109)
    texts = pa.array(["w1 w2 w3 tail w70", "w70 w99 w1", ""])
    first, plain = lm_score.Sums(None), lm_score.Sums(lm_score.Model())
    for sums in (first, plain):
        sums.add(lm_score.Group(texts, v), v)
        sums.finished(v)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(first.expected, plain.expected)) and all((a == b).all() for a, b in zip(first.met, plain.met))


def test_lm_pair_and_skip_act_inside_a_head_class():
    v = lm_score.Vocabulary([(w, 100) for w in ["x", "a", "b", "c", "d", ""]], {}, 600, 6)  # all in one class
    m = trained(["a x c", "b x d"] * 800, v, 30)
    acc, acd, bxd, bxc = scores(m, v, ["a x c", "a x d", "b x d", "b x c"])
    assert acc > acd + 0.3 and bxd > bxc + 0.3


def test_lm_head_word_beyond_256_depends_on_history():
    v = lm_score.Vocabulary([(f"w{i}", 2000 - i) for i in range(1000)], {}, 1_500_000, 1000)
    m = trained(["w1 w900", "w2 w901"] * 800, v, 30)
    a, b, c, d = scores(m, v, ["w1 w900", "w1 w901", "w2 w901", "w2 w900"])
    assert a > b + 0.3 and c > d + 0.3


def tail_corpus(spark):
    frequent = [" ".join(f"f{i}" for i in range(1100))] * 5
    # tail words of one class
    texts = [*frequent, *["l7 r7zz r9zz"] * 2, "l7 r8zz", "l8 r8zz", "l7 r7zz", "l7 r8zz", "l7 r6zz", "none r7zz", "none r8zz"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_lm_tail_words_by_pair_counts(spark, monkeypatch):
    real = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: (lm_score.Model(), real(*a)[1]))
    texts, df = tail_corpus(spark)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(df, F.col("doc_id") >= 9).collect()}
    count = collections.Counter(w for t in texts[:9] for w in [*t.split(), ""])
    head = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: lm_score.HEAD]}
    cls = lambda w: zlib.crc32(w[-2:].encode()) % lm_score.TAILS
    total = sum(c + 1 for w, c in count.items() if w not in head and cls(w) == cls("zz")) + 1
    share = {w: (count[w] + 1) / total for w in ("r6zz", "r7zz", "r8zz")}
    k = lm_score.PRIOR * 3**lm_score.POWER
    p = {w: (c + k * share[w]) / (3 + k) for w, c in (("r6zz", 0), ("r7zz", 2), ("r8zz", 1))}  # after l7: 3
    assert abs(got[9] - got[10] - math.log10(p["r7zz"] / p["r8zz"])) < 1e-5
    assert abs(got[9] - got[11] - math.log10(p["r7zz"] / p["r6zz"])) < 1e-5
    assert abs(got[12] - got[13] - math.log10(share["r7zz"] / share["r8zz"])) < 1e-5  # a word never met before


def test_lm_does_not_depend_on_layout_or_parts(spark, docs, monkeypatch):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    read = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in lm_score.score_texts(df, held_out).collect())
    some = docs.filter("length(text) < 5000")
    one = read(some.coalesce(1))
    monkeypatch.setattr(lm_score, "PART", 60)  # many parts; words of more than 60 tokens are split
    monkeypatch.setattr(lm_score, "SPLIT_WORDS", 10**9)
    other = read(some.repartition(6))
    assert [x[:4] for x in one] == [x[:4] for x in other]
    assert max(abs(a[4] - b[4]) for a, b in zip(one, other)) < 1e-3


def test_lm_held_out_is_far_better_than_unigrams(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm_score.score_texts(d, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > -3.70 and abs(got[1] + 4.1908) < 1e-3


def test_lm_sums_of_runs():
    r = np.random.default_rng(3)
    n = np.sort(np.concatenate([r.integers(1, 40, 50), [15, 16, 17, 300], np.ones(20, int)]))[::-1]
    first, order = np.cumsum(n) - n, r.permutation(n.sum())
    x = r.normal(size=(n.sum(), 8)).astype(np.float32)
    assert np.allclose(lm_score._sums(x, order, first, n), np.add.reduceat(x[order], first, axis=0), atol=1e-4)


# --- 2 ---

ASSIGN = re.compile(secrets.KINDS[0][1].replace("(?i)", ""), re.I | re.A)


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        least = next((c[2] for c in secrets.CLASSES if re.search(c[1], m[0])), None)
        if least is None or any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        share = lambda w: -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
        hits = [i for i in range(len(m[0]) - 19) if share(m[0][i : i + 20]) >= least - 1e-9]
        if hits and not any(a <= m.start() + hits[0] and m.start() + hits[-1] + 20 <= b for a, _, b in out):
            more.append((m.start() + hits[0], 3, m.start() + hits[-1] + 20))
    return sorted(out), sorted(out + more)


def test_secrets_beside_separators_and_allowed_words(spark, tmp_path):
    token, upper = "3ax6xnjp29jd6fds4gc373sgvjxteol0", "K3J9X0P2M8Q7W1Z5V4N6"
    found = {
        f"key-{token}": [(4, 36)],
        "auth=k3j9x0p2m8q7w1z5v4n6": [(5, 25)],
        f"a {upper}-{upper} b": [(2, 22), (23, 43)],
        f"/example/{token}": [(9, 41)],
        f"dummy{token}": [],
        f"sha256-{token}": [],
        "just-a-long-row-of-words/and_more": [],
        token: [(0, 32)],
    }
    spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["spans"] for x in secrets.op2_secrets(spark, str(tmp_path)).collect()}
    for i, (text, spans) in enumerate(found.items()):
        assert got[i] == ",".join(f"entropy:{a}:{b}" for a, b in spans), text


def test_secrets(spark):
    r = random.Random(4)
    bits = ["token = '", "password:", "AKIA", "api_key=", "ABCDEF1234567890XYZW", "deadbeef" * 3, "é😀", " ", "secret", '"', "Zx9Qw3Er5Ty7Ui1Op2As4Df6", "abc", "=", "123e4567-e89b-12d3-a456-426614174000", "sha256-abcdefABCDEF0123456789+/xyzXYZ", "x" * 30]
    cases = ["", None, "secret=token: abcdefgh"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(150)]
    got = {x["doc_id"]: x for x in secrets.find_secrets(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, t in enumerate(cases):
        base, every = plain_spans(t or "")
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == base
        assert sorted((s["start"], s["kind"], s["end"]) for s in [*got[i]["base"], *got[i]["entropy"]]) == every, t


def test_secret_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op2_secrets"](spark, str(tmp_path)).filter("base_sha256 = sha2('', 256) AND n_hex = 0").count() == docs.count()


# --- 3 ---


def test_token_counts_at_every_prefix(docs, pdf, none):
    by = token_counts.counter(token_counts.vocabulary())
    encode = lambda t: len(by.library.encode(t, add_special_tokens=False).ids)
    r = random.Random(5)
    pool = [*"aest  \n\t'srevl,.=-01\"<|>_", "'re", "<|endoftext|>", "<|endo", "é", "ß", "　", "漢", "😀", "\x85", "\x1c", "hello", "   "]
    for _ in range(200):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 20)))
        want = [encode(t[:i]) for i in range(len(t) + 1)]
        assert by.counts(t).tolist() == want and by.total(t) == want[-1]
        for limit in (0, 2, 5):
            assert by.fit(t, limit)[1] == max(i for i, n in enumerate(want) if n <= limit)
    got = token_counts.token_counts(docs).toPandas()
    assert sorted(zip(got.n_bytes, got.n_tokens)) == sorted((len((t or "").encode()), encode(t or "")) for t in pdf["text"])
    assert token_counts.token_counts(none).count() == 0
    short = docs.filter("length(text) < 300")
    table = token_counts.prefix_table(short)
    for x in short.join(token_counts.fitting(table, 9), "doc_id").join(token_counts.at_prefix(table, 12), "doc_id").select("text", "chars", "n_tokens").collect():
        assert encode(x["text"][: x["chars"]]) <= 9 and x["n_tokens"] == encode(x["text"][:12])


def test_workers_keep_the_columns_of_the_words_they_met(monkeypatch):
    by = token_counts.PrefixCounter(token_counts.vocabulary())
    words = by.words("internationalization is naïve, isn't it? 12345 \u20ac\u20ac")
    by.total("".join(words))
    monkeypatch.setattr(by, "byte_column", lambda word: pytest.fail("computed again"))
    for word in words:
        assert by.column(word) == [len(by.library.encode(word[: i + 1], add_special_tokens=False).ids) for i in range(len(word))], word
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    by.clear()
    by.columns.clear()
    by.total(" ".join(f"word{i}xyz" for i in range(50)))
    assert len(by) <= 3 and len(by.columns) <= 3


# --- 4 ---


def plain_shingles(t, width=5):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {" ".join(w)} - {""}


def test_decontamination(spark, docs, pdf):
    r = random.Random(6)
    texts = [t for t in pdf["text"] if t and len(t.split()) > 30]
    items = []
    for i in range(40):
        w = r.choice(texts).split()
        a = r.randrange(len(w) - 25)
        part = w[a : a + r.randint(8, 25)]
        if i % 3 == 0:
            part[r.randrange(len(part))] = "other"
        items.append((i, " ".join(part).upper() if i % 2 else ", ".join(part), "x"))
    items += [(90, None, "x"), (91, "", "x"), (92, "One", "x"), (93, "two, words!", "x")]
    got = {(a, b, round(s, 6)) for a, b, s in decontam.contained(docs, spark.createDataFrame(items, "item_id long, text string, doc_id string")).select("doc_id", "item_id", "containment").collect()}
    want = set()
    for i, t, _ in items:
        q = plain_shingles(t)
        for d, x in zip(pdf["doc_id"], pdf["text"]):
            share = len(q & plain_shingles(x)) / len(q) if q else 0
            if share >= 0.8:
                want.add((None if d is None else int(d), i, round(share, 6)))
    assert got == want and len(want) > 30
    bad = {d for d, _, _ in want}
    left = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string, doc_id string"))
    assert left.columns == docs.columns and left.count() == sum((None if d is None else int(d)) not in bad for d in pdf["doc_id"])
    assert decontam.contained(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontaminate_keeps_clean_rows_without_or_with_repeated_ids(spark):
    item = "one two three four five six seven eight"
    rows = [(None, f"a {item} b"), (None, "clean without an id"), (7, item), (7, "clean with a repeated id"), (8, None), (None, None), (None, f"a {item} b")]
    left = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))


# --- 5, 6 ---


def plain_quality(model, text):
    """The score of one text by the network's formulas, a passage and a word at a time."""
    found = [w for w in re.split(r"[\t-\r ]+", text or "") if w]
    if not found:
        return model.prior
    low, passages = [w.lower() for w in found], []
    for at in range(0, len(found), quality.PASSAGE):
        end, rows = min(at + quality.PASSAGE, len(found)), []
        for w in found[at:end]:
            h, signs = int(pd.util.hash_array(np.array([w.lower()], object), categorize=False)[0]), [0] * quality.HASHED
            signs[h % quality.HASHED] = 1 if h >> 63 else -1
            shares = [len(re.findall(c, w)) / len(w) for c in ("[A-Z\xc0-\xde]", "[0-9]", r"[|#$%&*!<>{}=+~^@_\\/]", "[.,;:?]", r"[^\x00-\x7F]")]
            rows.append([min(len(w), 40) / 10, len(w) <= 3, *shares, *signs])
        again = sum(i > 0 and low[i] == low[i - 1] for i in range(at, end))
        passages.append([*np.mean(rows, 0), np.std([r[0] for r in rows]), again / (end - at), len(set(low[at:end])) / (end - at), math.log1p(end - at) / 4])
    p, weights, encoded = model.p, [], []
    for x in np.clip((np.array(passages) - model.mean) / model.scale, -5, 5):
        h = np.tanh(x @ p["W"] + p["b"])
        weights.append(math.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        encoded.append(h)
    z = sum(w * h for w, h in zip(weights, encoded)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["c0"][0])))


def test_quality(spark, sf, docs, none):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    model = quality.fit(d, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = quality.scored(d, model).select("doc.doc_id", "score").join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    assert ((got.score >= quality.CUT) == (got.quality == 1)).mean() > 0.95
    out = quality.scored(docs, model)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert out.select("doc.*").columns == docs.columns
    for text, score in out.select("doc.text", "score").collect():
        assert abs(score - plain_quality(model, text)) < 2e-3
    none_learned = quality.fit(docs, spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r[0] for r in quality.scored(docs, none_learned).select("score").collect()} == {0.5}
    assert quality.scored(none, model).count() == 0


def test_quality_slopes():
    r = np.random.default_rng(0)
    m, x, n, y = quality.Bags(5), r.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1, 0, 1.0])
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    loss = lambda: -np.mean(y * np.log(m.forward(x, n)[-1]) + (1 - y) * np.log(1 - m.forward(x, n)[-1]))
    slopes = m.slopes(m.forward(x, n), n, y)
    for k, p in m.p.items():
        at = (0,) * p.ndim
        keep = p[at]
        p[at] = keep + 1e-5
        up = loss()
        p[at] = keep - 1e-5
        assert abs((up - loss()) / 2e-5 - slopes[k][at]) < 1e-4
        p[at] = keep


def test_language(docs, none):
    model = langid.fit(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    got = langid.predicted(docs, model, F.lit(False)).join(docs.select("doc_id", "text", "lang"), "doc_id").filter("doc_id < 120").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    every = langid.predicted(docs, model, F.lit(False)).toPandas()
    assert len(every) == docs.count()
    assert set(every[every.doc_id.isin([400, 401, 402, 409])].lang_pred) == {"und"} and "und" not in set(every[every.doc_id.isin([403, 406, 408])].lang_pred)
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.fit(none, F.lit(True)), F.lit(False)).collect()} == {"und"}
    assert langid.predicted(none, model, F.lit(False)).count() == 0


# --- 7 ---


def test_binary_fuse():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 100, 20000):
        keys = r.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(keys, *f).all()
        assert exact_dedup.in_filter(r.integers(0, 2**63, 50000).astype(np.uint64), *f).mean() < 0.001


@pytest.mark.parametrize("split", ["doc_id % 2 = 0", "true", "false"])
def test_exact_dedup(docs, pdf, none, split):
    got = exact_dedup.exact_groups(docs, F.expr(split)).toPandas().astype(object)
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in pdf["text"]]
    groups = collections.defaultdict(list)
    for d, t in zip(pdf["doc_id"], normal):
        groups[t].append(d)
    for t, ids in groups.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        mine = got[got.text_sha256 == digest]
        assert len(mine) == len(ids) and set(mine.group_size) == {len(ids)} and mine.kept.sum() == 1
        keep = None if None in ids else min(ids)
        assert all((pd.isna(k) and keep is None) or k == keep for k in mine.keep_id)
    assert exact_dedup.exact_groups(none, F.expr(split)).count() == 0


# --- 8 ---


def test_differencing():
    assert sorted(np.bincount(sharding.difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]
    r = random.Random(1)
    sizes = [r.randint(1, 1000) for _ in range(500)] + [100000]
    sums = np.bincount(sharding.difference(sizes, 8), sizes, 8)
    assert sums.sum() == sum(sizes) and sorted(sums)[-1] == 100000 and np.ptp(sorted(sums)[:-1]) <= 1000
    assert len(sharding.difference([], 8)) == 0


def test_sharding(docs, pdf, none, monkeypatch):
    monkeypatch.setattr(sharding, "TOP", 40)  # so that levels are built
    monkeypatch.setattr(sharding, "BUCKET", 32)
    monkeypatch.setattr(sharding, "PARTS", 8)
    got = sharding.shard_rows(docs.select("doc_id", "text"), 4).toPandas()
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in pdf["text"])
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() <= max(sums.sum() / 4 * 1.002, got.groupby("text_crc32")["size"].sum().max())
    out = sharding.with_shards(docs, 4)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and out.count() == docs.count()
    assert sharding.with_shards(none, 4).count() == 0


def plain_shards(sizes, parts):
    """The part of each item of {item: size}: the two partial partitions of largest spread are combined, oppositely ordered; ties go by age."""
    partial = [(size, -i, [(size, [item])] + [(0, [])] * (parts - 1)) for i, (item, size) in enumerate(sorted(sizes.items(), key=lambda g: (-g[1], g[0])))]
    age = len(partial)
    while len(partial) > 1:
        partial.sort(key=lambda p: p[:2])
        one, other = partial.pop()[2], partial.pop()[2]
        both = sorted(((s + t, a + b) for (s, a), (t, b) in zip(one, reversed(other))), key=lambda x: -x[0])
        both = [(s - both[-1][0], items) for s, items in both]
        partial.append((both[0][0], -age, both))
        age += 1
    return {item: part for part, (_, items) in enumerate(partial[0][2]) for item in items}


@pytest.mark.parametrize("parts", [2, 8])
def test_shards_equal_plain_differencing(docs, pdf, parts):
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()
    sizes = collections.Counter()
    for t in pdf["text"]:
        sizes[digest(t)] += len((t or "").encode()) + 1
    want = plain_shards(sizes, parts)
    got = sharding.with_shards(docs, parts).select("text", "shard").collect()
    assert len(got) == len(pdf) and all(r["shard"] == want[digest(r["text"])] for r in got)


# --- 9 ---


@pytest.mark.parametrize("same", [False, True])
def test_mix_does_not_depend_on_the_layout(spark, same):
    """Rows without an id, and rows that differ in one column only."""
    rows = [(7 if same else None, "one text" if same else f"text number {i}", "s" if i % 4 else "t", f"l{i}", i) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    a, b = (sorted(map(str, mixing.mixed(t).collect())) for t in (table.repartition(3), table.orderBy(F.desc("n_chars")).coalesce(2)))
    assert a == b and 100 < len(a) < 800


def test_rows_without_an_id_spread_over_ranges(spark):
    table = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.md5(F.col("id").cast("string")).alias("mark")).cache()
    got = mixing.taken(table, table)
    assert got.agg(F.sum("taken")).first()[0] == 90_000
    plan = got._jdf.queryExecution().toString()
    assert "_range" in plan and table.count() == got.count()



def test_mixing(spark, docs, pdf, none):
    sized = docs.select("doc_id", "source", mixing.words().alias("size"), mixing.mark().alias("mark"), "_key").cache()
    got = mixing.taken(sized, sized).toPandas()
    assert sorted(got["size"]) == sorted(len(words(t)) for t in pdf["text"])
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (by.taken == np.floor(by.target)).all() and (got.taken <= 2 * got["size"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    free = by[by.target < 2 * by["size"] - 1e-6]  # those below their cap share by weight
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(x for x in by.index if isinstance(x, str)))}
    weights[None] = (3, 1, 2)[len(weights) % 3]
    rates = [row.target / weights[s if isinstance(s, str) else None] for s, row in free.iterrows()]
    assert len(rates) and max(rates) - min(rates) < 1e-6 * max(rates)
    again = mixing.taken(sized.repartition(3), sized).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.groupBy("doc_id", "text").count().filter("doc_id <> 5").agg(F.max("count")).first()[0] <= 2
    assert "_key" in got.columns
    assert mixing.mixed(none).count() == 0 and mixing.taken(sized.limit(0), sized.limit(0)).count() == 0


# --- 10 ---


def plain_groups(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "num", "den", "block"), [(3, 90, 100, 400_000), (5, 8, 10, 400_000), (3, 8, 10, 600)])
def test_jaccard_groups(docs, pdf, none, monkeypatch, width, num, den, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # the least one deals families as pairs of blocks
    got = jaccard_join.jaccard_groups(docs, width, num, den).collect()
    rows = [(None if d is None else int(d), t) for d, t in zip(pdf["doc_id"], pdf["text"])]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_groups(rows, width, num, den)
    assert jaccard_join.jaccard_groups(none, width, num, den).count() == 0


def test_signatures_lose_no_pair():
    r = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10)):
        bands = jaccard_join.Bands(num, den)
        for _ in range(400):
            n = int(r.integers(1, 150))
            a = r.integers(0, 2**63, n).astype(np.uint64)
            k = int(r.integers(0, max(1, (den - num) * n // num) + 1))
            b = np.concatenate([a[: n - k // 2], r.integers(0, 2**63, k - k // 2).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if both and den * both >= num * (len(a) + len(b) - both):
                sa, sb = np.concatenate(bands.signatures(a)), np.concatenate(bands.signatures(b))
                assert len(np.intersect1d(sa, sb))


def test_sketches_lose_no_pair():
    r = np.random.default_rng(5)
    make = lambda n: np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    for num, den in ((9, 10), (8, 10)):
        for n in (1, 4, 30, 33, 200, 1000):
            sets = []
            for _ in range(12):
                a = make(n)
                for k in range(1, 6):  # some at the threshold, some on either side of it, of other sizes
                    cut = int(r.integers(0, n // k + 1)) if k < 5 else 0
                    sets.append(np.unique(np.concatenate([a[cut:], make(int(r.integers(0, n // 4 + 1)))])))
            sets = [s for s in sets if len(s)]
            similar = lambda a, b: den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))
            sizes, sketches, every = np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets], np.arange(len(sets))
            for side in (np.zeros(len(sets), int), every % 2):
                root = every.copy()
                for x, y in jaccard_join.near_in_block(sizes, sketches, side, every, num, den):
                    assert side[0] == side[1] or side[x] != side[y]
                    root[root == root[y]] = root[x]
                assert all(root[x] == root[y] for x in every for y in every[:x] if similar(sets[x], sets[y]) and (side[0] == side[1] or side[x] != side[y]))


def test_texts_of_a_family_do_not_travel_once_a_block(spark, monkeypatch):
    """Sets that share much, of which few are linked, in many blocks."""
    r, rows, fetched = random.Random(4), [], []
    base = [f"w{i}" for i in range(200)]
    for i in range(300):
        w = list(base)
        for k in r.sample(range(0, 200, 5), r.choice([3, 12, 14])):  # each changes five shingles: similarities from under 0.4 to over 0.8
            w[k] = f"c{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    written = jaccard_join.materialize

    def counted(df, *how, **more):
        out = written(df, *how, **more)
        if "rep_tag" in out.columns and {"i", "lead"} & set(out.columns):
            fetched.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4000)  # about 20 sets
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == plain_groups(rows, 5, 8, 10)
    assert 0 < sum(fetched) <= 4 * len(rows)


def test_links_of_near_copies_do_not_grow_with_the_parts(spark, monkeypatch):
    r, links = random.Random(9), []
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(150)] = f"c{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    of, made = jaccard_join.links_of, []

    def counted(*how):
        out = jaccard_join.materialize(of(*how))
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "links_of", counted)
    nodes = len({int(x) for _, t in rows for x in jaccard_join.Bands(8, 10).nodes(*set_and_key(t))})
    assert nodes < len(rows)  # copies that agree on a part are one node
    for part in (60_000, 1_500):  # about 4 and 100 parts, 1 and 13 tasks
        monkeypatch.setattr(jaccard_join, "PART", part)
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_groups(df, 5, 8, 10).collect()}
        assert got == dict((d, c) for d, _, c in plain_groups(rows, 5, 8, 10))
        links.append(made.pop())
    assert links[0] < nodes and links[1] < nodes * 14, (links, nodes)


def set_and_key(text):
    s = shingles.shingle_sets(pa.array([text]), 5)[0]
    return s, int(jaccard_join.set_keys([s])[0][0])


def test_written_tables_can_be_deleted(spark):
    from siftwork.llm import common

    common.clean(spark)  # other tests of the session have written some
    kept = common.materialize(spark.range(3))
    place = Path(common._tables(spark))
    assert kept.count() == 3 and place.exists() and common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with common.scratch(spark):
        inside = common.materialize(spark.range(4))
        assert inside.count() == 4 and len(list(place.iterdir())) == 2
        named = common.materialize(inside, kept_as="mine")
    assert named.count() == 4 and len(list(place.iterdir())) == 2 and kept.count() == 3
    common.forget(spark, "mine")
    assert not (place / "mine").exists()
    common.clean(spark)
    assert not place.exists()


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert set(got) == set(near)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)


def test_a_hub_of_links_is_spread_over_tasks(spark, monkeypatch):
    """Stars about their least and about their greatest node, the latter linked to each other."""
    from siftwork.llm import components as c, common

    n, seen = 20_000, []
    low = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    high = spark.range(n, 2 * n).select(F.lit(3 * n).cast("long").alias("a"), F.col("id").alias("b"))
    joined = c._with_least

    def watched(links):
        out = joined(links)
        of_hubs = out.filter(F.col("a").isin(0, 3 * n)).groupBy("a", F.spark_partition_id().alias("task")).count()
        seen.extend(of_hubs.groupBy("a").agg(F.sum("count"), F.max("count")).filter("sum(count) > 1000").collect())
        return out

    monkeypatch.setattr(c, "_with_least", watched)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
            spark.conf.set(k, v)
        got = c.components(common.materialize(low.unionByName(high).unionByName(spark.createDataFrame([(n + 5, 7)], "a long, b long")).repartition(6)))
        assert got.agg(F.count("*"), F.max("root")).first()[:] == (2 * n + 1, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r[0] for r in seen} == {0, 3 * n} and all(r[2] <= 0.5 * r[1] for r in seen)


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, oracle, same):
    same(queries.QUERIES[name](spark, sf), oracle.execute(queries.ORACLE_SQL[name]).df())


def test_near_duplicates_do_not_depend_on_the_layout(spark):
    """Rows of one id and text that differ in source: the least stays, in every layout."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i // 3, text + f" v{i // 9}", f"s{i % 3}", None, i) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    a, b = (sorted(map(str, stage(spark, t, "").collect())) for t in (table.repartition(3), table.orderBy(F.desc("n_chars")).coalesce(2)))
    assert a == b and len(a) >= 1


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_buckets_pass_all_wanted_and_few_others(spark, n):
    from siftwork.llm import common

    wanted = common.materialize(spark.range(0, n * 10, 10).select(F.when(F.col("id") > 0, F.col("id")).alias("k")))
    rows = spark.range(50_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    near, far = (common.by_bucket(rows, F.col("id"), wanted, F.col("k"), how) for how in ("left_semi", "left_anti"))
    assert near.columns == ["id"] and near.count() + far.count() == 50_000
    assert near.join(wanted, F.col("id").eqNullSafe(F.col("k")), "left_semi").count() == n
    assert near.count() <= n + 0.12 * 50_000


def test_pipeline(spark, docs, tmp_path, none):
    labels = [(i, 1, 0) for i in range(0, 60)] + [(408, 0, 0)]
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    item = docs.filter("doc_id = 7").first()["text"]
    spark.createDataFrame([(1, " ".join(item.split()[:40]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, d)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    roots = {c for i, n, c in plain_groups([tuple(r) for r in rows], 5, 8, 10) if n}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None and i not in (400, 401, 402)} == {c for c in roots if c is not None} and ids.count(5) == 1
    assert {400, 401, 402} <= set(ids)
    other = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    fixed = docs.select(*other).first()
    assert all(tuple(r) == tuple(fixed) for _, stage in corpus_pipeline.STAGES[1:4] for r in stage(spark, docs, d).select(*other).distinct().collect())
    clean = stages["benchmark decontamination"](spark, docs, d)
    assert clean.filter("doc_id = 7").count() == 0 and clean.filter("doc_id = 8").count() == 1
    out = corpus_pipeline.run(spark, d)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 50
    from siftwork.llm import common

    left = [p for p in Path(common._tables(spark)).iterdir() if p.name.startswith("stage-")]
    assert len(left) == 1  # of what the run has written, the result stays
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0, name




def test_many_secrets_in_one_text(spark):
    """More spans than are gathered at once, of which some fail."""
    text = " ".join(f"token={'a' * (4 + i % 4)}{i:04d}" if i % 3 else "token=abc" for i in range(700))
    found = spark.createDataFrame([(text,)], "text string").select(secrets._spans(F.col("text"), r"token=([a-z0-9]+)", 1, 6).alias("s")).first()["s"]
    want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"token=([a-z0-9]+)", text) if len(m[1]) >= 6]
    assert [tuple(s) for s in found] == want and len(want) > 400
