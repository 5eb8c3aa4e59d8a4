import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from twinsieve.llm import toxicity as t, polyhash

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def plain_features(text, bits):
    """The same features, a word at a time."""
    words, word = [], bytearray()
    for b in [*text.lower().encode(), 32]:
        if t._WORD[b]:
            word.append(b)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    h = [mix(sum((c + 1) * pow(polyhash._BASE, polyhash.KEPT + i, 1 << 64) for i, c in enumerate(w)) & m) for w in words]
    out = set(h)
    out |= {mix(a * int(t._PAIR) + b & m) for a, b in zip(h, h[1:])}
    out |= {mix(a * int(t._SKIP) + b & m) for a, b in zip(h, h[2:])}
    return sorted({x >> (64 - bits) for x in out})


def test_features_equal_plain():
    texts = ["You are, so bad!", "", None, "x", "Äpfel äpfel", "a b\nc  d-e", "word" * 4000, "one two"]
    got = t.distinct_features(pa.array(texts), 22)
    assert [g.tolist() for g in got] == [plain_features(x or "", 22) for x in texts]


def corpus(n=400):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 40))
        bad = i % 4 == 0
        rows.append((i, f"{text} {rng.choice(['vile', 'nasty'])} {text}" if bad else text, int(bad)))
    return rows


def test_held_out_accuracy_and_filter(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in t.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert {r.doc_id for r in t.without_toxic(docs, labels).collect()} == {i for i in got if not got[i].predicted}


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], DOCS)
    flip = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = t.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS))
    b = t.train(docs, spark.createDataFrame(flip, LABELS))
    assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and a[2].tolist() == b[2].tolist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "x " * 50_000, None), (2, "x " * 50_000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 1)], LABELS)
    for labels in (none, odd):
        assert t.toxicity(docs, labels).count() == 4
        kept = t.without_toxic(docs, labels)
        assert kept.columns == docs.columns
    assert t.toxicity(docs.limit(0), none).count() == 0


def test_sparsity():
    rows = [np.array([i % 7, 100 + i], "u4") for i in range(300)]
    y = np.array([i % 7 == 0 for i in range(300)], float)
    at, w = t.FtrlModel(t.Ftrl(bits=12, l1=5)).fit(rows, y).sparse()
    assert 0 < len(at) < 20 and w[at == 0][0] > 0


def plain_ftrl(rows, labels, p):
    """Per-coordinate FTRL-proximal with a number at a time; a batch's gradients are added up first. Returns bias and weights."""
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        l1 = 0.0 if i == "bias" else p.l1
        l2 = 0.0 if i == "bias" else p.l2
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        mixed = order.permutation(len(rows)).tolist()
        for at in range(0, len(mixed), p.batch):
            grad = {}
            part = mixed[at : at + p.batch]
            for j in part:
                score = weight("bias") + sum(weight(i) for i in rows[j])
                error = 1 / (1 + math.exp(-score)) - labels[j]
                for i in ["bias", *rows[j]]:
                    grad[i] = grad.get(i, 0.0) + error
            old = {i: weight(i) for i in grad}
            for i, g in grad.items():
                held = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(held + g * g) - math.sqrt(held)) / p.alpha * old[i]
                n[i] = held + g * g
    return weight("bias"), {i: weight(i) for i in z if i != "bias" and weight(i)}


def test_training_equals_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 12))).astype("u4") for _ in range(150)]
    y = np.array([float(3 in r or 5 in r) for r in rows])
    for p in (t.Ftrl(bits=8, l1=0.4, epochs=3, batch=7), t.Ftrl(bits=8, alpha=0.3, l1=0.0, l2=0.5, epochs=2, batch=1)):
        model = t.FtrlModel(p).fit(rows, y)
        bias, want = plain_ftrl([r.tolist() for r in rows], y.tolist(), p)
        at, w = model.sparse()
        assert model.bias() == pytest.approx(bias) and dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)


def test_scores_equal_plain_sums(spark):
    rows = corpus(150)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(9000, None)], DOCS)
    bias, at, w = t.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS))
    weights = dict(zip(at.tolist(), w.astype("f4").tolist()))
    texts = {i: x for i, x, _ in rows}
    assert weights
    for r in t.scored(docs, (bias, at, w)).collect():
        total = bias + sum(weights.get(b, 0.0) for b in plain_features(texts.get(r.doc_id) or "", 22))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)


def test_training_stays_within_its_bytes(spark):
    rows = corpus(100)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    assert not len(t.train(docs, labels, t.Ftrl(max_bytes=10))[1])
    clash = docs.selectExpr("*", "5 as _toxicity", "6 as _id", "7 as _text", "8 as _y")
    kept = t.without_toxic(clash, labels)
    assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} == {(5, 6, 7, 8)}
