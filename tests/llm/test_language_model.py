import random
import zlib

import numpy as np
import pytest

import brute
from vitrine.llm.language_model import EXACT, arrangements, language_model, many_tables, seating, spread, squeeze


def corpus(n=120, seed=1):
    """A chain of words: what follows depends on the word before."""
    rnd = random.Random(seed)
    after = {w: rnd.sample(range(60), 3) for w in range(60)}
    rows = []
    for key in range(n):
        w, text = rnd.randrange(60), []
        for _ in range(rnd.randint(0, 60)):
            text.append(f"W{w}" if rnd.random() < 0.1 else f"w{w}")
            w = rnd.choice(after[w])
        rows.append((key, " ".join(text)))
    return rows


def test_counts_base_and_held_out_gain(table):
    rows = [*corpus(), (900, None), (901, ""), (902, "unseen words only"), (903, "w1 " * 20_000), (7, "w1 w2"), (None, "w3 w4")]
    got = sorted([tuple(r) for r in language_model(table(rows)).collect()], key=str)
    want = sorted(brute.unigrams(rows), key=str)
    assert [(g[0], g[2], g[3], g[4]) for g in sorted(got, key=lambda g: str((g[0], g[2])))] == [
        w[:4] for w in sorted(want, key=lambda w: str((w[0], w[1])))]
    base = {(w[0], w[1]): w[4] for w in want}
    assert all(abs(g[5] - base[g[0], g[2]]) < 1e-6 * (1 + abs(g[5])) and np.isfinite(g[6]) and g[6] < 0 for g in got)
    assert all(g[1] == (zlib.crc32(("" if g[0] is None else str(g[0])).encode()) % 5 == 1) for g in got)
    held = [g for g in got if g[1] and g[0] is not None and g[0] < 120]
    assert sum(g[6] for g in held) > 0.75 * sum(g[5] for g in held)


def test_short_texts_share_one(table):
    """The empty text and all texts of one word, known or not, are disjoint: their probabilities add up to 1 at most."""
    train = [(k, t) for k, t in corpus(40) if zlib.crc32(str(k).encode()) % 5 != 1]
    vocabulary = sorted({w for _, t in train for w in brute.words(t)})
    texts = ["", *vocabulary, "never-seen"]
    keys = [k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 5 == 1][:len(texts)]
    score = {r["doc_id"]: r["score"] for r in language_model(table(train + list(zip(keys, texts)))).collect()}
    total = sum(10 ** score[k] for k in keys)
    assert 0 < total <= 1 + 1e-9


def test_seating_bounds_and_repeatability():
    rng = np.random.default_rng(2)
    count = rng.integers(0, 200, 2000)
    fresh = rng.random(2000) * 3 + 1e-6
    key = rng.integers(0, 1 << 56, 2000).astype(np.uint64)
    t = seating(count, fresh, key, 0.6)
    assert ((t >= (count > 0)) & (t <= count)).all() and (t[count == 1] == 1).all()
    assert (t == seating(count, fresh, key, 0.6)).all()
    few, many = (seating(np.full(2000, 10), np.full(2000, f), key, 0.6).mean() for f in (0.01, 5.0))
    assert few < 1.5 < many


def test_gibbs_frequencies_of_two_customers():
    """Two customers share a table with odds (1 - d) to the weight of a new one."""
    key = np.arange(40_000).astype(np.uint64)
    t = seating(np.full(len(key), 2), np.full(len(key), 0.8), key, 0.5)
    assert abs((t.mean() - 1) - 0.8 / (0.8 + 0.5)) < 0.02


def test_frequent_dishes_are_sampled():
    """The tables of many customers vary, around the mean of the distribution by arrangements."""
    key = np.arange(20_000).astype(np.uint64)
    for n, f in ((40, 0.8), (EXACT, 0.05), (EXACT, 20.0)):
        t = np.arange(1, n + 1)
        p = np.exp(t * np.log(f) + arrangements(0.6)[n, 1:n + 1] - arrangements(0.6)[n, 1])
        p /= p.sum()
        mean, variance = (p * t).sum(), (p * t * t).sum() - (p * t).sum() ** 2
        got = seating(np.full(len(key), n), np.full(len(key), f), key, 0.6)
        assert abs(got.mean() - mean) < 5 * (variance / len(key)) ** 0.5 and abs(got.var() - variance) < 0.1 * variance
        m, v = many_tables(np.array([float(n)]), np.array([f]), 0.6)
        if n == EXACT:
            assert abs(1 + m[0] - mean) < 0.1 * mean and abs(v[0] - variance) < 0.2 * variance
    for f in (0.01, 1.0, 300.0):
        got = seating(np.full(len(key), 100_000), np.full(len(key), f), key, 0.6)
        m, v = many_tables(np.array([1e5]), np.array([f]), 0.6)
        assert abs(got.mean() - 1 - m[0]) < 5 * (v[0] / len(key)) ** 0.5 and 0.8 * v[0] < got.var() < 1.2 * v[0]


def chain_scores(train, held, sweeps=60, seed=3):
    """log10 scores by a sequential sampler: a dish at a time, given the tables of all others and the parent."""
    rng = np.random.default_rng(seed)
    pairs, words = {}, {}
    for text in train:
        last = "<s>"
        for w in [*brute.words(text), "</s>"]:
            pairs[last, w] = pairs.get((last, w), 0) + 1
            words[w] = words.get(w, 0) + 1
            last = w
    once, twice = (sum(c == n for c in pairs.values()) for n in (1, 2))
    d, base = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5, 1 / (len(words) + 1)
    logs, tables = arrangements(d), {p: 1 for p in pairs}
    followed, held_by = {}, {}
    for (u, _), c in pairs.items():
        followed[u] = followed.get(u, 0) + c
        held_by[u] = held_by.get(u, 0) + 1
    total = [np.zeros(len([*brute.words(t), "</s>"])) for t in held]
    d0, parent_tables = 0.5, {w: 1 for w in words}
    for sweep in range(sweeps):
        customers = {w: 0 for w in words}
        for (_, w), t in tables.items():
            customers[w] += t
        n = sum(customers.values())
        back = (1 + d0 * sum(parent_tables.values())) * base
        for w, c in customers.items():
            p = np.arange(1, c + 1) * np.log(back) + arrangements(d0)[c, 1:c + 1]
            p = np.exp(p - p.max())
            parent_tables[w] = 1 + rng.choice(c, p=p / p.sum())
        back = (1 + d0 * sum(parent_tables.values())) * base
        parent = {w: (max(c - d0 * parent_tables[w], 0) + back) / (1 + n) for w, c in customers.items()}
        if sweep >= sweeps // 2:
            for text, out in zip(held, total):
                last = "<s>"
                for k, w in enumerate([*brute.words(text), "</s>"]):
                    below = (1 + d * held_by.get(last, 0)) * parent.get(w, back / (1 + n))
                    seen = max(pairs.get((last, w), 0) - d * tables.get((last, w), 0), 0)
                    out[k] += (seen + below) / (1 + followed.get(last, 0)) / (sweeps - sweeps // 2)
                    last = w
        for (u, w), c in pairs.items():
            held_by[u] -= tables[u, w]
            p = np.arange(1, c + 1) * np.log((1 + d * held_by[u]) * parent[w]) + logs[c, 1:c + 1]
            p = np.exp(p - p.max())
            tables[u, w] = 1 + rng.choice(c, p=p / p.sum())
            held_by[u] += tables[u, w]
        one, two = (sum(c == k for c in customers.values()) for k in (1, 2))
        d0 = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    return [float(np.log10(t).sum()) for t in total]


def test_seating_follows_the_hierarchy(table):
    """Scores as a sampler's that visits one dish at a time, not those of weights fixed beforehand."""
    rnd = random.Random(9)
    hubs = [f"h{k}" for k in range(12)]
    rows = [(k, " ".join(f"{rnd.choice(hubs)} {rnd.choice(['the', 'of', rnd.choice(hubs)])} r{rnd.randrange(300)}" for _ in range(12)))
            for k in range(200)]
    split = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    held = [(k, t) for k, t in rows if split(k)]
    want = chain_scores([t for k, t in rows if not split(k)], [t for _, t in held])
    got = {r["doc_id"]: r["score"] for r in language_model(table(rows)).collect()}
    n = sum(len(brute.words(t)) + 1 for _, t in held)
    gap = abs(sum(got[k] for k, _ in held) - sum(want)) / n
    assert gap < 0.002, gap


def test_empty_and_no_training(table):
    assert language_model(table([])).count() == 0
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = language_model(table([(key, "a b")])).collect()
    assert (row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)


def test_byte_planes_round_trip():
    for v in (np.array([], np.int64), np.arange(1000, dtype=np.uint64) ** np.uint64(3), np.array([True, False]), np.array([1.5, -2.0])):
        assert (spread(squeeze(v), v.dtype) == v).all() and len(spread(squeeze(v), v.dtype)) == len(v)


def test_words_are_hashed_a_few_texts_at_a_time(monkeypatch):
    """Sums over the text, 32 bytes for each of its bytes, never cover a whole block, and keys do not tell."""
    import numpy as np

    from vitrine.llm import language_model as lm

    texts = [b"one two", b"", b"three  one", b" ", b"two " * 50, b"four"]
    low, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, seen, sums = lm.word_keys(low, off), [], lm.prefix_hash
    monkeypatch.setattr(lm, "HASHED_BYTES", 20)
    monkeypatch.setattr(lm, "prefix_hash", lambda piece: seen.append(len(piece)) or sums(piece))
    for got, want in zip(lm.word_keys(low, off), whole):
        assert got.tolist() == want.tolist()
    assert len(whole[0]) == 55 and max(seen) == 200 and sorted(seen)[-2] <= 20  # a longer text alone
    assert whole[0][0] == whole[0][3] and whole[1].tolist() == [0, 0, 2, 2] + [4] * 50 + [5]


def test_seating_draws_what_all_numbers_of_tables_give():
    """What is left out and the order of the work change no draw, and little more than the likely tables is worked out."""
    from vitrine.llm import language_model

    rnd = np.random.default_rng(5)
    count = rnd.integers(2, EXACT + 1, 4000)
    fresh, key = np.exp(rnd.normal(-1, 3, 4000)), rnd.integers(0, 1 << 62, 4000).astype(np.uint64)
    worked, exp = [], np.exp
    ways = arrangements(0.6)
    whole = []
    for c, f, u in zip(count, fresh, language_model.uniform(key, 5)):
        p = np.log(f) * np.arange(1, c + 1) + ways[c, 1:c + 1]
        p = np.cumsum(np.exp(p - p.max()))
        whole.append(min(1 + (p <= u * p[-1]).sum(), c))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_model.np, "exp", lambda x: worked.append(np.size(x)) or exp(x))
        assert (seating(count, fresh, key, 0.6, 2) == np.array(whole)).all()
        worked.clear()
        seating(np.full(4000, EXACT), np.full(4000, 0.01), key, 0.6, 2)
    assert sum(worked) < 4000 * EXACT / 4
