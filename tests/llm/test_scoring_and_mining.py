"""Recurrent scores, importance resampling and hard negatives against brute force and on edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import gru, negatives, resampling
from lectern.llm.negatives import mine_negatives, mine_negatives_query, reaching
from lectern.llm.recurrent import log_likelihood
from lectern.llm.resampling import batch_features, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- the recurrent model -------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    shape = gru.Shape(70, 5)
    flat = gru.first_weights(shape, np.arange(70, 0, -1), 3).astype(np.float64)
    w = shape.unpack(flat)
    for name in w:
        w[name] += rng.normal(scale=0.2, size=w[name].shape)
    w["word_b"].reshape(-1)[70:] = -60
    return shape, w, [rng.integers(0, 70, n) for n in (9, 4, 3, 1, 12)]


def plain_probability(w, history, words):
    """The distribution after `history`, one step and one class at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h = w["turn"].shape[0]
    state = np.zeros(h)
    for token in [gru.END, *history]:
        a, b = w["inputs"][token], state @ w["turn"]
        r, z = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
        state = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * state
    soft = lambda v: np.exp(v) / np.exp(v).sum()
    classes = soft(state @ w["class_w"] + w["class_b"])
    inner = [soft(state @ w["word_w"][c] + w["word_b"][c]) for c in range(len(classes))]
    return np.array([classes[i // gru.CLASS_SIZE] * inner[i // gru.CLASS_SIZE][i % gru.CLASS_SIZE] for i in range(words)])


@pytest.mark.parametrize("lanes,steps", [(1, 3), (2, 5), (8, 100)])
def test_scores_of_whole_documents_equal_a_plain_loop(model, lanes, steps):
    shape, w, docs = model
    want = [sum(math.log(plain_probability(w, d[:i], 70)[d[i]]) for i in range(len(d))) for d in docs]
    np.testing.assert_allclose(gru.score({k: v.astype(np.float32) for k, v in w.items()}, docs, lanes, steps), want, rtol=2e-5)
    assert plain_probability(w, docs[0], 70).sum() == pytest.approx(1)


def test_gradients_equal_finite_differences(model):
    shape, w, docs = model
    plan = gru.Lanes.of(docs, 2)
    n, at, real = next(plan.windows(11))
    targets, zero = plan.tokens[at[real]], np.zeros((n, 5))

    def loss():
        states, _, _ = gru.run(w, plan.inputs[at], plan.fresh[at], zero, False)
        return -gru.log_probabilities(w, states[real], targets).sum() / 7

    grads, _ = gru.gradients(w, plan.inputs[at], plan.fresh[at], real, targets, zero, 7)
    for name, g in grads.items():
        full = np.zeros_like(w[name])
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full = g
        for place in np.argsort(-np.abs(full), axis=None)[:3]:
            i = np.unravel_index(place, full.shape)
            old, step = w[name][i], 1e-5
            w[name][i] = old + step
            above = loss()
            w[name][i] = old - step
            below = loss()
            w[name][i] = old
            assert full[i] == pytest.approx((above - below) / 2 / step, rel=1e-4)


def test_training_learns_an_order(model):
    docs = [np.array([2, 3, 4, 5] * 30 + [0], np.uint16) for _ in range(60)]
    shape = gru.Shape(40, 8)
    start = gru.first_weights(shape, np.bincount(np.concatenate(docs), minlength=40), 1)
    flat, steps = gru.train(shape, start, docs, 8, 8, 0.1)
    score = lambda f: gru.score(shape.unpack(f), docs[:1], 4, 16)[0] / len(docs[0])
    assert steps > 50 and score(flat) > score(start) / 4
    assert gru.train(shape, start, [], 8, 8, 0.1)[1] == 0


def plain_base(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    c = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws, h in zip(tokens, held)]


def recurrent(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, row string, score int")
    return log_likelihood(docs, **options).collect()


def test_base_scores_and_counts_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"W{rng.zipf(1.5)}" for _ in range(rng.integers(1, 80)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "É é Ä"), (74, "one " * 30_000), (75, "z" * 100_000), rows[3], rows[3], (None, "w1 w2")]
    for lookup in (1 << 17, 4):  # nearly all counts looked up; nearly all joined
        got = sorted(recurrent(spark, rows, lookup_words=lookup, model_words=6), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"]))
        want = sorted(((k is None, k, p) for (k, _), p in zip(rows, plain_base(rows))), key=lambda x: (x[0], x[1], x[2][4]))
        assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(k, *p[:4]) for _, k, p in want]
        np.testing.assert_allclose([r["base_score"] for r in got], [p[4] for _, _, p in want], rtol=1e-9)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_recurrent_scores_without_training_texts_and_on_an_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = recurrent(spark, [(i, "a b") for i in held])
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert recurrent(spark, []) == []


def test_model_beats_the_unigram_on_held_out_documents(spark):
    got = log_likelihood(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.9


# --- importance resampling -------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


TEXTS = ["The cat sat.", None, "", "...", "É été 3 x" * 9, "a" * 70 + " b " + "c" * 24 + " " + "d" * 25, "w1 w2\x00w3", "Wort " * 500, "x" * 20_000]


def test_features_of_joined_texts_equal_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(4)
    texts = TEXTS + [" ".join(f"t{rng.integers(50)}é" for _ in range(rng.integers(90))) for _ in range(30)]
    for window in (1 << 20, 64, 7):
        monkeypatch.setattr(resampling, "WINDOW", window)
        got = [[] for _ in texts]
        for doc, buckets in batch_features(pa.array(texts, pa.string())):
            for d, b in zip(doc, buckets):
                got[d].append(int(b))
        assert [sorted(g) for g in got] == [sorted(plain_features(t)) for t in texts]


def plain_resample(rows, target):
    s = collections.Counter(b for _, t in rows for b in plain_features(t))
    t = collections.Counter(b for x in target for b in plain_features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for k, text in rows:
        f = plain_features(text)
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = list(enumerate(TEXTS + [" ".join(f"v{rng.integers(40)}" for _ in range(rng.integers(10, 60))) for _ in range(80)]))
    rows += [rows[20], rows[20], rows[20], (None, rows[21][1])]  # repeated rows tie; a null key
    target = ["v1 v2 v3", None, "", "v1 v2 the cat"]
    docs = spark.createDataFrame([(k, t, 5, "y") for k, t in rows], "doc_id long, text string, weight int, _row string").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert sorted((tuple(r) for r in resample(docs, items).collect()), key=str) == plain_resample(rows, target)
    assert sorted((tuple(r) for r in resample(docs, items.limit(0)).collect()), key=str) == plain_resample(rows, [])
    assert resample(docs.limit(0), items).count() == 0


# --- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, every=50):
    whole = lambda v: tuple(math.floor(256 * x) for x in v)
    ok = [(k, y, whole(v)) for k, y, v in rows if k is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted(set(ok))
    out = []
    for i, (k, y, v) in enumerate(ok):
        if k % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, z, w) in enumerate(ok) if n != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            found = [(n, s) for s, n, z in scored if z != y and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(k, j, r + 1, n, -p, -s) for r, (n, s) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(k, v, y, 1, "z") for k, y, v in rows], "vec_id long, embedding array<double>, label int, dim int, packed string")
    return sorted(tuple(r) for r in mine_negatives(table, **options).collect())


def some_vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [(i, int(i % labels), (0.8 * centres[rng.integers(labels)] + rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim,levels", [(20, None), (3, None), (20, (0.0,))])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, levels):
    if levels:
        monkeypatch.setattr(negatives, "POSITIVE_LEVELS", levels)
        monkeypatch.setattr(negatives, "NEGATIVE_LEVELS", (0.5,))
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 8)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 64)
    rows = some_vectors(300, dim, dim)
    rows += [(400 + i, y, v) for i, (_, y, v) in enumerate(rows[:40])]  # ties under other keys
    assert mined(spark, rows, anchor_every=10) == plain_negatives(rows, 10)


def test_negatives_on_edge_cases(spark):
    rows = some_vectors(60, 6, 1, labels=2)
    rows += [rows[0], rows[0], rows[7]]  # equal rows count once
    rows += [(0, 1, [0.5] * 6)]  # the key of another row
    rows += [(None, 0, [1.0] * 6), (900, None, [1.0] * 6), (901, 0, None), (902, 0, [None] + [1.0] * 5), (903, 0, [float("nan")] * 6), (904, 0, [float("inf")] * 6)]
    rows += [(950, 0, [0.0] * 6), (951, 1, [0.0] * 6), (960, 0, []), (970, 0, [1.0, 2.0]), (971, 1, [1.0, 1.0]), (-50, 0, [-1.0] * 6), (-51, 1, [-2.0] * 6)]
    assert mined(spark, rows, anchor_every=10) == plain_negatives(rows, 10)
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == []


def test_negatives_are_exact_for_large_numbers(spark):
    rows = [(k, y, [x * 50_000.0 + 1 / 256 for x in v]) for k, y, v in some_vectors(40, 4, 9)]
    assert mined(spark, rows, anchor_every=10) == plain_negatives(rows, 10)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.1, 0.0, -0.5])
def test_pruned_products_lose_nothing(share):
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (400, 30)) * (rng.random((400, 1)) * np.linspace(2, 0.01, 30)).astype(np.float64)
    x = x.astype(np.int64)
    q = x[:25]
    products = q @ x.T
    least = (share * products.max(1)).astype(np.int64)
    a, r, score = reaching(q, x, least)
    want = sorted((i, j, int(products[i, j])) for i, j in zip(*np.nonzero(products >= least[:, None])))
    assert sorted(zip(a.tolist(), r.tolist(), score.tolist())) == want


def test_query_moves_every_seventh_label(spark):
    rows = some_vectors(100, 8, 5, labels=10)
    table = spark.createDataFrame([(k, v, y) for k, y, v in rows], "vec_id long, embedding array<double>, label int")
    moved = [(k, (y + 1) % 10 if k % 7 == 0 else y, v) for k, y, v in rows]
    assert sorted(tuple(r) for r in mine_negatives_query(table).collect()) == plain_negatives(moved)
    assert mine_negatives_query(table.withColumn("label", F.lit(None).cast("int"))).count() == 0
