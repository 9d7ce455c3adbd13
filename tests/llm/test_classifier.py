import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lanternql.llm import classifier as q
from tests.llm import cases


def mean_logit(text, weights, bias):
    f = q.features(text, {})
    return bias + (float(weights[f].sum()) / f.size if f.size else 0.0)


def corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text = cases.prose(rng, rng.randint(30, 120))
        bad = rng.random() < 0.25
        if bad:
            text = rng.choice([str.upper, lambda t: t.replace(" ", "%%% "), lambda t: " ".join(f"{w} {w} {w} {w}" for w in t.split()[:20])])(text)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), 0))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_features():
    f = q.features(b"ab ab", {})
    assert f.size == 2 * (1 + 2 + 1) + 1 and f[-1] == 0  # <ab>: two 3-grams, one 4-gram
    assert q.features(None, {}).size == 0
    assert len(q.word_features(b"x" * 500)) == 1


def test_score_is_the_mean_of_all_features():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=q.BUCKETS).astype(np.float32)
    texts = [None if r[1] is None else r[1].encode() for r in cases.documents()]
    got = q.score(texts, weights, 0.3, {})
    want = 1 / (1 + np.exp(-np.array([mean_logit(t, weights, 0.3) for t in texts])))
    assert got == pytest.approx(want, abs=1e-5)


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    docs = cases.clashing(cases.frame(spark, rows + cases.documents(20)[20:]))
    marks = label_frame(spark, labels + [(3, None, 0), (None, 1, 0), (4, 7, 0), (10**6, 1, 0)])
    model = q.fit(docs, marks)
    got = q.scored(docs, model).collect()
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # Labels of the held-out fold change nothing.
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    again = q.fit(docs, label_frame(spark, other))
    assert (again[0] == q.fit(docs, label_frame(spark, labels))[0]).all()


def test_sample_is_bounded(spark):
    rows, labels = corpus(100)
    seen = []
    real = q.train
    q.train = lambda texts, y: seen.append(len(texts)) or real(texts, y, epochs=1)
    try:
        q.fit(cases.frame(spark, rows), label_frame(spark, labels), sample=20)
    finally:
        q.train = real
    assert seen == [20]


def test_without_labels(spark):
    docs = cases.frame(spark)
    none = label_frame(spark, [])
    assert {round(r.score, 6) for r in q.scored(docs, q.fit(docs, none)).collect()} == {0.5}
    ones = label_frame(spark, [(i, 1, 0) for i in range(30)])
    assert all(r.score > 0.99 for r in q.scored(docs, q.fit(docs, ones)).collect())
    assert q.scored(cases.empty(spark), q.fit(cases.empty(spark), none)).collect() == []


def test_held_out_accuracy_on_tables(spark):
    d = "/root/testdata/sf0.01"
    got = q.op7_subword_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


@pytest.mark.parametrize("block", [q.BLOCK, 7])
def test_ngrams_in_bulk_are_those_one_by_one(block, monkeypatch):
    monkeypatch.setattr(q, "BLOCK", block)
    words = [b"a", "été".encode(), b"word", b"x" * q.LONG, "長い文字列が空白なしに続くこと".encode() * 9, b"zebra" * 300]
    got = [[] for _ in words]
    for word, bucket in q.grams(words):
        for w, b in zip(word.tolist(), bucket.tolist()):
            got[w].append(b)
    for w, mine in zip(words, got):
        marked = b"<" + w + b">"
        assert sorted(mine) == sorted(zlib.crc32(marked[i : i + n], n) % q.BUCKETS for n in q.NGRAMS for i in range(len(marked) - n + 1))
        if len(w) <= q.LONG:
            assert sorted(q.word_features(w)[1:]) == sorted(mine)
        assert q.features(w, {}).size == 1 + len(mine)


def test_words_without_blanks_are_scored_by_their_ngrams(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("良好文章清晰" if i % 2 else "賭博中奬免費", k=200)) for i in range(120)]
    docs = cases.frame(spark, [(i, t, "zh", "s", 0) for i, t in enumerate(texts)])
    marks = label_frame(spark, [(i, i % 2, 0) for i in range(120)])
    held = q.scored(docs, q.fit(docs, marks)).where("held_out").collect()
    assert len(held) > 10 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in held)


def brute_train(texts, labels, dim, epochs, rate):
    """Stochastic gradient descent by the definition, one number at a time."""
    share = sum(labels) / len(labels)
    rng = np.random.default_rng(q.SEED)
    vectors = rng.uniform(-1 / dim, 1 / dim, (q.BUCKETS, dim)).astype(np.float32).astype(float)
    out, bias, steps = [[0.0] * dim, [0.0] * dim], [math.log(1 - share), math.log(share)], 0
    bags = [Counter(q.features(t, {}).tolist()) for t in texts]
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            bag, n = bags[i], sum(bags[i].values())
            lr = rate * (1 - steps / (epochs * len(texts)))
            steps += 1
            hidden = [sum(c / n * vectors[f][k] for f, c in bag.items()) for k in range(dim)]
            z = [sum(out[c][k] * hidden[k] for k in range(dim)) + bias[c] for c in (0, 1)]
            e = [math.exp(x) for x in z]
            grad = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            down = [sum(out[c][k] * grad[c] for c in (0, 1)) for k in range(dim)]
            for c in (0, 1):
                out[c] = [out[c][k] - lr * grad[c] * hidden[k] for k in range(dim)]
                bias[c] -= lr * 0.1 * grad[c]
            for f, c in bag.items():
                vectors[f] -= 4 * lr * min(c / n * len(bag), 20) * np.array(down)
    return vectors, out, bias


def test_training_against_brute_force():
    rng = random.Random(4)
    texts = [cases.prose(rng, 12).encode() if i % 2 else " ".join(rng.choices(["buy", "win", "free"], k=9)).encode() for i in range(14)]
    labels = [i % 2 for i in range(14)]
    weights, bias = q.train(texts, labels, dim=4, epochs=3, rate=0.3)
    vectors, out, want = brute_train(texts, labels, 4, 3, 0.3)
    assert bias == pytest.approx(want[1] - want[0], abs=1e-4)
    for f in {x for t in texts for x in q.features(t, {}).tolist()}:
        assert weights[f] == pytest.approx(float(vectors[f] @ (np.array(out[1]) - np.array(out[0]))), abs=1e-4)


def test_sample_is_bounded_after_the_join(spark, monkeypatch):
    rows = [(1, f"text number {i} " * 20, "en", "s", 0) for i in range(300)] + [(2, "other words " * 10, "en", "s", 0)] * 3
    seen = []
    monkeypatch.setattr(q, "train", lambda texts, y: seen.append(texts) or (np.zeros(q.BUCKETS, np.float32), 0.0))
    docs, marks = cases.frame(spark, rows), label_frame(spark, [(1, 1, 0), (2, 0, 0), (3, 0, 0)])
    q.fit(docs, marks, sample=50)
    assert len(seen[-1]) == 50
    monkeypatch.setattr(q, "SAMPLE_BYTES", 2000)
    q.fit(docs, marks)
    assert 0 < sum(map(len, seen[-1])) <= 2000
    q.fit(docs, label_frame(spark, [(2, 0, 0)]))
    assert seen[-1] == [b"other words " * 10] * 3  # repeated rows count each
