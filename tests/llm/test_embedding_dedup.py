import numpy as np

import brute
from vitrine.llm.embedding_dedup import MultiIndex, embedding_dedup, spanning


def plain(rows, cosine=0.95):
    """Links by brute force over rows (id, vector)."""
    ok = {}
    for k, (i, v) in enumerate(rows):
        good = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok[k] = np.array(v, float) / np.linalg.norm(v) if good else None
    links = [(a, b) for a in ok for b in ok if a < b and ok[a] is not None and ok[b] is not None
             and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    near = brute.smallest([(rows[a][0], rows[b][0]) for a, b in links], {i for i, _ in rows if i is not None})
    count = [sum(k in link for link in links) for k in ok]
    return sorted(((i, count[k], near.get(i), i == near.get(i)) for k, (i, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows],
                               "vec_id long, embedding array<float>, key string, size int").repartition(3)
    return sorted((tuple(r) for r in embedding_dedup(df, **options).collect()), key=str)


def families(seed, n, dim=16, spread=0.08):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // 6), dim))
    return [(k, (centre[rng.integers(len(centre))] + spread * rng.normal(size=dim)).astype(np.float32).tolist())
            for k in range(n)]


def test_against_brute_force_with_odd_rows(spark):
    rows = families(1, 240)
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [2 * x for x in rows[0][1]]), (903, None), (904, []),
             (905, [0.0] * 16), (906, [float("nan")] * 16), (907, [float("inf")] + [1.0] * 15), (None, rows[0][1]),
             (908, [None] + rows[1][1][1:]), (909, rows[1][1][:8]), (910, [3.0]), (911, [5.0]), (912, [1e30] * 16)]
    assert found(spark, rows) == plain(rows)


def test_recall_over_a_hot_cell_and_many_equal_vectors(spark):
    rows = families(2, 700, dim=8, spread=0.2) + [(1000 + k, [1.0] * 8) for k in range(500)]
    got, want = found(spark, rows), plain(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_empty_and_nothing_to_link(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_multi_sequence_order_is_the_order_of_summed_distances():
    rng = np.random.default_rng(3)
    index = MultiIndex(rng.normal(size=(200, 6)), 7)
    x = rng.normal(size=(20, 6))
    a, b = index.both(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for cells in (1, 5, 20, 49):
        seen = index.visits(x, cells)
        assert np.allclose(np.take_along_axis(total, seen, 1), np.sort(total, axis=1)[:, :cells])
    assert (index.visits(x, 1)[:, 0] == index.home(x)).all()
    assert (index.ranks(x, index.home(x)) == 0).all()


def test_spanning_links_connect_the_same():
    rng = np.random.default_rng(4)
    for _ in range(30):
        left, right = np.arange(9), np.arange(20, 31)
        mask = rng.random((9, 11)) < 0.1
        ids = [*left.tolist(), *right.tolist()]
        a, b = spanning(mask, left, right)
        want = brute.smallest([(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(mask))], ids)
        assert brute.smallest(list(zip(a.tolist(), b.tolist())), ids) == want
