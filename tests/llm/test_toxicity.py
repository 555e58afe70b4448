import random
import zlib

import numpy as np
import pytest

from vitrine.llm.toxicity import DECAY, features, fit, toxicity, vector, without_toxic, word_pieces

INSULTS = ["blockhead", "nitwit", "scoundrel"]


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice(["ta", "re", "mi", "son", "lu", "pe", "dor"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for key in range(n):
        text = rnd.choices(plain, k=rnd.randint(5, 40))
        toxic = rnd.random() < 0.25
        for _ in range(2 if toxic else 0):
            text.insert(rnd.randint(0, len(text)), rnd.choice(INSULTS))
        docs.append((key, " ".join(text)))
        labels.append((key, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return fit(df, marks, sample_docs=2000, train_words=400), docs, dict(labels)


def kernel(a, b):
    """Common subsequences of three characters, by definition."""
    def weights(w):
        w, out = f"\0{w}\0", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(s, 0) for s, v in x.items()) / norm


def test_features_give_the_subsequence_kernel():
    for a, b in (("idiot", "idi-ot"), ("banana", "anna"), ("ab", "ab"), ("abcabc", "cba"), ("x", "yy")):
        (ca, va), (cb, vb) = vector(a), vector(b)
        x, y = np.zeros(30 ** 3), np.zeros(30 ** 3)
        np.add.at(x, ca, va)
        np.add.at(y, cb, vb)
        assert abs(x @ y - kernel(a, b)) < 1e-12


def test_long_words_are_read_whole():
    word, start, end = word_pieces(np.zeros(100, np.uint8), np.array([0, 10]), np.array([5, 100]))
    assert set(range(10, 100)) == {p for w, a, b in zip(word, start, end) if w == 1 for p in range(a, b)}
    assert features(np.ones((2, 1), np.int64))[0].shape == (2, 1)


def test_held_out_accuracy(spark, table, fitted):
    model, docs, labels = fitted
    rows = toxicity(table(docs), model).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_gaps_inserted_characters_and_cases(table, fitted):
    model, _, _ = fitted
    clean = "ta re mi " * 30_000
    rows = [(1, "you block-head there"), (2, "b l o c k h e a d"), (3, "NITWIT"), (4, "nit.wit"), (5, clean),
            (6, clean + " scoundrel"), (7, None), (8, ""), (9, "re mi dor"), (9, "re mi dor"), (None, "nitwit")]
    out = {}
    for r in toxicity(table(rows), model).collect():
        out.setdefault(r["doc_id"], []).append(r["predicted"])
    assert out == {1: [1], 2: [1], 3: [1], 4: [1], 5: [0], 6: [1], 7: [0], 8: [0], 9: [0, 0], None: [1]}
    kept = without_toxic(table(rows), model)
    assert kept.columns == table(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 7, 8, 9, 9]


def test_without_labels_of_both_kinds(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        model = fit(table([(1, "a b"), (3, "c")]), labels)
        assert [r["score"] < 0.01 for r in toxicity(table([(1, "a b")]), model).collect()] == [True]
    assert toxicity(table([]), model).count() == 0


def test_weak_words_add_up(spark, table):
    """Words with the stem are in most texts; only many of them make a text toxic."""
    rnd = random.Random(5)
    parts = ["ta", "re", "mi", "son", "lu", "pe", "dor", "é", "ê"]
    docs, labels = [], []
    for key in range(900):
        toxic = rnd.random() < 0.25
        text = ["".join(rnd.choices(parts, k=rnd.randint(2, 4))) for _ in range(40)]
        for k in range(rnd.randint(7, 10) if toxic else rnd.choice([0, 1, 1])):
            text[4 * k] = "zlorx" + "".join(rnd.choices(parts, k=2))
        docs.append((key, " ".join(text)))
        labels.append((key, int(toxic)))
    model = fit(table(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_docs=2000, train_words=400)
    held = [r for r in toxicity(table(docs), model).collect() if r["held_out"]]
    assert sum(r["predicted"] == dict(labels)[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_letters_beyond_ascii_are_told_apart():
    def cells(word):
        return {int(c): round(float(v), 12) for c, v in zip(*vector(word)) if v}

    assert len({frozenset(cells(w).items()) for w in ("résu", "rêsu", "rüsu", "rжsu", "r語su", "r😀su")}) == 6
    assert cells("RÉSU") == cells("résu") and cells("ЖУК") == cells("жук")
