import random

import brute
from pyspark.sql import functions as F

from vitrine.llm import jaccard_join
from vitrine.llm.components import components
from vitrine.llm.jaccard_join import jaccard_components


def near_copies(rnd, families=12, size=8):
    rows, key = [], 0
    for f in range(families):
        base = [f"w{f}_{rnd.randint(0, 40)}" for _ in range(rnd.choice([3, 5, 12, 60, 120]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = f"x{rnd.randint(0, 5)}"
            rows.append((key, " ".join(text)))
            key += 1
    return rows


def found(df):
    return sorted(tuple(r) for r in jaccard_components(df).collect())


def test_against_brute_force(table):
    rows = near_copies(random.Random(1))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three four"),
             (906, "long " * 3000), (907, "long " * 5000)]
    assert found(table(rows)) == brute.jaccard(rows)


def test_common_line_and_hot_copies(table):
    rnd = random.Random(2)
    line = " ".join(f"c{k}" for k in range(30))
    rows = [(k, line + " " + " ".join(f"u{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 8)))) for k in range(80)]
    rows += [(100 + k, "the very same text of some words here") for k in range(60)]
    assert found(table(rows)) == brute.jaccard(rows)


def test_repeated_ids_null_ids_and_empty(table):
    out = jaccard_components(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_components(table([])).count() == 0


def test_any_order_of_shingles_gives_the_same(table, monkeypatch):
    rows = near_copies(random.Random(3), families=5)
    want = brute.jaccard(rows)
    import numpy as np

    for seed in (0, 1):
        level = np.random.default_rng(seed).integers(0, 5, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
        monkeypatch.setattr(jaccard_join, "common_levels", lambda docs, level=level: level)
        assert found(table(rows)) == want


def test_sets_far_apart_are_no_candidates(table, monkeypatch):
    """Sets that share a phrase but are far apart make few candidates, however many shingles and sets share it."""
    rnd = random.Random(4)
    phrase = " ".join(f"c{k}" for k in range(24))
    rows = [(k, phrase + " " + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(70))) for k in range(120)]
    base = [f"b{k}" for k in range(100)]  # pairs at the threshold's two sides, with wider and narrower gaps
    rows += [(500 + k, " ".join(base[:100 - k] + [f"y{k}_{j}" for j in range(k)])) for k in range(0, 30, 3)]
    import numpy as np

    level = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)  # as if no count had told that the phrase is common
    monkeypatch.setattr(jaccard_join, "common_levels", lambda docs: level)
    seen, whole = {}, jaccard_join.materialize
    verified = jaccard_join.verified

    def watched(pairs, *more):
        pairs = whole(pairs, "pairs")
        seen[len(seen)] = pairs.count()
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard_join, "verified", watched)
    assert found(table(rows)) == brute.jaccard(rows)
    assert seen[2] < 60  # the last round; the phrase has 7,140 pairs


def test_near_copies_without_a_hub_meet_before_all_pairs_do(table, monkeypatch):
    """The smallest ids lead every list and are far from all; the near copies still leave few pairs for the last round."""
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(base[k:k + 5])) for k in range(146)]
    rows += [(200 + k, " ".join([*base[:2 * k + 5], f"y{k}", *base[2 * k + 6:]])) for k in range(60)]
    seen, whole = [], jaccard_join.materialize
    verified = jaccard_join.verified

    def watched(pairs, *more):
        pairs = whole(pairs, "pairs")
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard_join, "verified", watched)
    assert found(table(rows)) == brute.jaccard(rows)
    assert seen[-1] < 100  # 60 near copies have 1,770 pairs


def test_maps_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np

    rnd = np.random.default_rng(5)
    sets = [rnd.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 7, 300, 5000)]
    sets += [np.concatenate([sets[3][:280], sets[2]]), sets[3][:-1]]
    at = np.cumsum([0, *map(len, sets)])
    maps = jaccard_join.parity_maps(np.concatenate(sets), at)
    for x, a in zip(sets, maps):
        for y, b in zip(sets, maps):
            bits = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (len(x) != len(y))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20, 60)] + [(1, k) for k in range(2, 15)] + [(14, 20), (70, 71), (99, 98)]
    out = components(spark.createDataFrame(links, "a long, b long"))
    want = brute.smallest(links, {x for link in links for x in link})
    assert {r["id"]: r["component"] for r in out.collect()} == want


def test_components_of_many_links_meet_by_one_pair(table, monkeypatch):
    """Two groups whose sets are near each other, though not their leaders, are joined without all pairs."""
    base = [f"b{k}" for k in range(300)]

    def changed(**places):
        return " ".join(next((f"{name}{k}" for name, at in places.items() if k in at), w) for k, w in enumerate(base))

    rows = [(k, " ".join(base[k:k + 5])) for k in range(296)]  # lead the lists of what both groups have
    rows += [(1001, changed(a=(10, 20, 30, 40))), (1002, changed(c=(60, 70, 80, 90)))]
    rows += [(1010 + k, changed(a=(10, 20), **{f"x{k}y": (105 + 6 * k,)})) for k in range(30)]
    rows += [(1050 + k, changed(c=(60, 70), **{f"z{k}y": (108 + 6 * k,)})) for k in range(30)]
    seen, whole = [], jaccard_join.materialize
    verified, near, calls = jaccard_join.verified, jaccard_join.near, []

    def watched(pairs, *more):
        pairs = whole(pairs, "pairs")
        seen.append(pairs.count())
        return verified(pairs, *more)

    def without_pivots(percent):
        calls.append(percent)
        return F.lit(False) if len(calls) == 1 else near(percent)

    monkeypatch.setattr(jaccard_join, "verified", watched)
    monkeypatch.setattr(jaccard_join, "near", without_pivots)
    assert found(table(rows)) == brute.jaccard(rows)
    assert max(seen[2:]) < 10  # the groups have 900 linked pairs


def test_new_links_join_labels(spark):
    from vitrine.llm.components import components, joined

    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first, more = [(2, 3), (3, 4), (6, 7), (9, 10)], [(4, 7), (1, 10), (11, 12), (2, 4)]
    labels = joined(components(frame(first)), frame(more))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, components(frame(first + more)).collect()))
