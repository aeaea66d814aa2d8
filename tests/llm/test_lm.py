"""The language model and its scores against plain versions."""

import collections
import math
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.llm import gru, lm

SF = "/root/testdata/sf0.01"


def random_weights(seed=3, scale=0.4):
    return (np.random.default_rng(seed).normal(0, scale, gru.SIZE)).astype(np.float32)


def random_texts(n, seed=4, most=200):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, gru.RARE + 1, rng.integers(0, most)), 0).astype("<u2") for _ in range(n)]


def plain_score(x, text):
    """Symbol by symbol, in double precision."""
    w = {k: v.astype(float) for k, v in gru.shaped(x).items()}
    h, before, total = np.zeros(gru.HIDDEN), 0, 0.0
    for s in text.tolist():
        a, b = w["embedding"][before] @ w["input"] + w["gate"], h @ w["state"]
        az, ar, an = np.split(a, 3)
        bz, br, bn = np.split(b, 3)
        z, r = 1 / (1 + np.exp(-az - bz)), 1 / (1 + np.exp(-ar - br))
        new = np.tanh(an + r * bn)
        h = (1 - z) * new + z * h
        logits = h @ w["classes"] + w["class_bias"]
        total += logits[s // gru.CLASS] - np.log(np.exp(logits).sum())
        if s != gru.RARE:
            logits = h @ w["words"][s // gru.CLASS] + w["word_bias"][s // gru.CLASS]
            total += logits[s % gru.CLASS] - np.log(np.exp(logits).sum())
        before = s
    return total / math.log(10)


def test_score_of_symbols(monkeypatch):
    """Whole texts over many windows, alone or beside others."""
    x, texts = random_weights(), [*random_texts(40), *random_texts(1, 5, 3000)]
    want = [plain_score(x, t) for t in texts]
    assert np.allclose(gru.log10_probabilities(gru.shaped(x), texts), want, rtol=1e-4)
    monkeypatch.setattr(gru, "SCORE_LANES", 3)
    assert np.allclose(gru.log10_probabilities(gru.shaped(x), texts), want, rtol=1e-4)
    assert np.allclose(gru.log10_probabilities(gru.shaped(x), texts[7:8]), want[7], rtol=1e-4)


def test_probabilities_add_up(monkeypatch):
    monkeypatch.setattr(gru, "SCORE_LANES", gru.RARE + 1)  # a lane for each, as none has an end here
    x = gru.shaped(random_weights())
    start = [np.array([s], "<u2") for s in range(gru.RARE + 1)]
    assert abs((10.0 ** gru.log10_probabilities(x, start)).sum() - 1) < 1e-4


def test_gradient():
    """Of one window that starts from a state, against differences of the loss."""
    x = random_weights(7, 0.3).astype(np.float64)
    texts = random_texts(3, 8, 9)
    lanes = gru.Lanes(texts, 2)
    at, inside = next(lanes.windows())
    h = np.random.default_rng(9).normal(0, 0.5, (at.shape[1], gru.HIDDEN))

    def loss(x):
        w = gru.shaped(x)
        gates = w["embedding"] @ w["input"] + w["gate"]
        states, symbols, total = gru._steps(w, gates, h, lanes.before[at]), lanes.symbols[at], 0.0
        for s, y in zip(states[inside].astype(float), symbols[inside]):
            a = s @ w["classes"] + w["class_bias"]
            total -= a[y // gru.CLASS] - np.log(np.exp(a).sum())
            if y != gru.RARE:
                b = s @ w["words"][y // gru.CLASS] + w["word_bias"][y // gru.CLASS]
                total -= b[y % gru.CLASS] - np.log(np.exp(b).sum())
        return total / inside.sum()

    g = np.zeros(gru.SIZE)
    w = gru.shaped(x)
    gru._gradient(w, w["embedding"] @ w["input"] + w["gate"], h, lanes.before[at], lanes.symbols[at], inside, gru.shaped(g))
    strong = np.argsort(-np.abs(g))[:2000]
    for i in [*strong[::60], *range(gru.SIZE - 1, 0, -gru.SIZE // 20)]:
        step = np.zeros(gru.SIZE)
        step[i] = 1e-3
        assert abs((loss(x + step) - loss(x - step)) / 2e-3 - g[i]) < 2e-4 + 0.02 * abs(g[i])


def test_training_learns_order():
    """A word that always follows another becomes likely after it only."""
    rng = np.random.default_rng(1)
    texts = [np.append(np.stack([p := rng.integers(1, 60, 30), p + 100], axis=1).ravel(), 0).astype("<u2") for _ in range(400)]
    counts = np.bincount(np.concatenate(texts), minlength=gru.RARE + 1).astype(float)
    trainer = gru.Trainer(gru.flat(gru.initial(counts)))
    before = gru.log10_probabilities(trainer.w, texts[:50]).sum()
    for _ in range(4):
        trainer.learn(texts[50:])
    assert gru.log10_probabilities(trainer.w, texts[:50]).sum() > 0.75 * before and trainer.symbols == 4 * 350 * 61


def plain_base(rows):
    """rows: (doc_id, text). doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, [*brute.WORD.findall((t or "").translate(brute.LOWER)), None]) for d, t in rows]
    c = collections.Counter(w for _, held, ws in tokens if not held for w in ws)
    total = math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    return [(d, held, len(ws), sum(c[w] > 0 for w in ws), sum(c.values()), sum(math.log10(c[w] + 0.1) - total for w in ws)) for d, held, ws in tokens]


def agree(got, rows):
    key = lambda r: tuple((x is None, x) for x in r[:5]) + (round(r[5], 4),)
    a = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    b = sorted(plain_base(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9, atol=1e-9)


def test_corpus(spark):
    """Counts and base scores as by hand; the model, which knows the order of words, does better on texts it hasn't seen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.query(spark, SF).collect()
    agree(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.08
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    again = {r.doc_id: r.score for r in lm.query(spark, SF).collect()}
    assert all(abs(again[r.doc_id] - r.score) <= 1e-3 + 1e-4 * abs(r.score) for r in got)


def test_edges(spark, nasty, monkeypatch):
    """Short lists, so that most words meet their counts in the join; rare words share the rest of their class."""
    monkeypatch.setattr(lm, "LISTED", 30)
    monkeypatch.setattr(lm, "LISTED_BYTES", 6)
    agree(lm.scores(nasty, lm.held_out()).collect(), [(r.doc_id, r.text) for r in nasty.collect()])
    only = nasty.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    rows = lm.scores(only, lm.held_out()).collect()
    agree(rows, [(r.doc_id, r.text) for r in only.collect()])
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    empty = lm.scores(nasty.limit(0), lm.held_out())
    assert empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and not empty.collect()


@pytest.mark.parametrize("text", ["common", "never", "once"])
def test_score_of_one_word(spark, monkeypatch, text):
    """The model's probability of the word's symbol, times a rare word's share of its class."""
    monkeypatch.setattr(lm, "LISTED", 1)
    rows = [(i, "common") for i in range(1, 40)] + [(100, "once other")]
    docs = spark.createDataFrame([*rows, (0, text)], "doc_id long, text string")
    seen = {}
    monkeypatch.setattr(lm, "train", lambda encoded, v: seen.setdefault("w", gru.flat(gru.initial(v.by_symbol()))))
    got = lm.scores(docs, F.col("doc_id") == 0).where("doc_id = 0").first()
    symbol = 1 if text == "common" else gru.RARE
    want = plain_score(seen["w"], np.array([symbol, 0], "<u2"))
    if symbol == gru.RARE:
        want += math.log10((1.1 if text == "once" else 0.1) / (2 + 0.1 * 3))
    assert abs(got.score - want) < 1e-4 and got.n_known == 1 + (text != "never")
