import random

import numpy as np

import brute
from vitrine.llm.suffix_dedup import fragments, previous_factors, repeated_spans


def found(df):
    rows = repeated_spans(df).collect()
    return sorted((r["id"], len(r["kept"]) + sum(s["bytes"] for s in r["removed"]), sum(s["bytes"] for s in r["removed"]),
                   len(r["removed"]), bytes(r["kept"])) for r in rows)


def test_against_brute_force(table):
    rnd = random.Random(1)
    passage = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(45, 160))) for _ in range(6)]
    rows = []
    for key in range(60):
        parts = [rnd.choice(passage) if rnd.random() < 0.6 else "".join(rnd.choices("abcdé \n", k=rnd.randint(0, 90)))
                 for _ in range(rnd.randint(0, 5))]
        rows.append((key, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 49), (103, "z" * 49), (104, "z" * 50), (105, "z" * 70), (106, "z" * 51),
             (107, rows[3][1]), (108, rows[3][1])]
    assert found(table(rows)) == brute.repeated(rows)


def test_repeated_ids_are_one_document(table):
    text = "".join(random.Random(2).choices("abcdefgh", k=80))
    rows = [(1, text), (1, text), (1, "other" + text[:60]), (2, text), (2, "short")]
    assert found(table(rows)) == brute.repeated(rows)


def test_empty_and_null_ids(table):
    assert repeated_spans(table([])).count() == 0
    text = "".join(random.Random(3).choices("abcdefgh", k=80))
    out = repeated_spans(table([(None, text), (5, text)])).collect()
    assert {r["id"]: len(r["kept"]) for r in out} == {None: 0, 5: 80}


def test_long_text_over_several_stretches(table):
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcdefghijklmnop ", k=300_000))
    rows = [(1, long), (2, "q" + long[1000:200_000] + "r")]
    (_, n, _, _, _), (_, n2, removed, runs, kept) = found(table(rows))
    assert (n, n2, removed, runs, kept) == (300_000, 199_002, 199_000, 1, b"qr")


def test_every_window_is_in_one_fragment():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 10, 60, 1000, 1000, 5000])
    _, start, size, row = fragments(buf, off)
    windows = sorted(s + k for s, n in zip(start, size) for k in range(n - 49))
    want = [k for a, b in zip(off[:-1], off[1:]) for k in range(a, b - 49)]
    assert windows == want and all(off[r] <= s and s + n <= off[r + 1] for s, n, r in zip(start, size, row))


def test_longest_previous_factor_against_definition():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    doc = np.sort(rng.integers(0, 6, 391))
    start = np.arange(391)
    got = previous_factors(text, start, doc, 10)
    raw = text.tobytes()
    want = [any(doc[j] < doc[i] and raw[j:j + 10] == raw[i:i + 10] for j in range(391)) for i in range(391)]
    assert got.tolist() == want
