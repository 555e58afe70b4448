import random
import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings, strategies as st

from vitrine.llm.filter_audit import interaction_audit, positional_popcount, subset_survivors, survival_words

ROWS = "doc_id long, text string, source string, id string, word string, part int, n long, digest string"
LABELS = "doc_id long, quality int, toxic int, label string, word string"


def failing(text, first):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    return out | ({"E"} if not first else set())


def brute(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = [(i, p or "", failing(t, i is None or i <= smallest[t or ""])) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                earlier = sum(name in f and bool(f & set(order[:step - 1])) for _, f in own)
                left = [d for d in left if name not in d[1]]
                removed_by[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), earlier, sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def found(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], ROWS).repartition(partitions)
    marks = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS)
    out = interaction_audit(subset_survivors(survival_words(docs), marks)).collect()
    return {(r["part"], r["filter_order"], r["step"]):
            [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out}


def texts(rnd, n):
    def one():
        kind = rnd.randint(0, 6)
        words = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.choice([3, 49, 50, 80]))]
        if kind == 1:
            words = ["la"] * 60 + words
        if kind == 2:
            words = [w.upper() for w in words]
        if kind == 3:
            words.insert(0, rnd.choice("#$%&*|"))
        return rnd.choice([" ", "\t\n", "\x0b "]).join(words) + rnd.choice(["", " ", "é "])

    made = [one() for _ in range(n // 2)]
    return [rnd.choice(made) for _ in range(n)]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, t, rnd.choice(["a", "b", None, ""])) for k, t in enumerate(texts(rnd, 160))]
    rows += [(None, rows[0][1], "a"), (None, None, "c"), (900, "", "c"), (901, None, "c"), (7, rows[7][1], "a"), (7, rows[7][1], "a")]
    rows += [(1000 + k, "same " * 70, "b") for k in range(60)]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (1003, 1, 0)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a b", "s")], []) == brute([(1, "a b", "s")], [])


def test_long_text_is_read_whole(spark):
    rows = [(1, "word " * 300_000 + "#", "s"), (2, " ".join(f"w{k}" for k in range(100_000)), "s")]
    assert found(spark, rows, []) == brute(rows, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=200))
def test_popcount(words):
    got = positional_popcount(np.array(words, np.uint32))
    assert got.tolist() == [sum(w >> k & 1 for w in words) for k in range(32)]
