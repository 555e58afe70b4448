import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm.packing import WordTokenizer, pack, places, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello, World!", "don't  stop\tnow\nit's 12345", "Straße ÄÖÜ ŒUVRE", "İstanbul Σίσυφος ΟΔΟΣ", "é" "́",
         "a\x1cb\x1fc", "x y z　w", "日本語 text 한국어", "\U0001f600 smile", "<|endoftext|>", "Ａ ﬁ ²½", "_" * 40]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(plain):
    rnd = random.Random(5)
    letters = "abcZÉßñ .,'’-12٣\t\n\x85\x1c  中😀ǅʼ́İΣ"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    own = WordTokenizer(PATH, cache_words=50)
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == [plain(t) for t in texts]


def test_cases(table, plain):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (101, "word " * 9000), (102, "Hello, World!"), (None, "x")]
    out = pack(table(rows), PATH).collect()
    want = {}
    for key, text in rows:
        ids = [*plain(text or ""), 0]
        want[key] = [(k, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))
                     for k, at in enumerate(range(0, len(ids), 2048))]
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    check_places(out)


def check_places(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_empty_table(table):
    assert pack(table([]), PATH).count() == 0


def used(plan):
    return sum(n for _, n in plan)


def test_plan_holds_every_piece_once():
    rnd = random.Random(2)
    for _ in range(60):
        capacity = rnd.choice([5, 16, 64])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 50) for _ in range(rnd.randint(1, 12))}
        plan = plan_bins(counts, capacity)
        held = {}
        for parts, n in plan:
            assert sum(parts) <= capacity and n > 0
            for p in parts:
                held[p] = held.get(p, 0) + n
        assert held == counts
        spans = {}
        for length, low, high, _, _ in places(plan):
            spans.setdefault(length, []).append((low, high))
        for length, s in spans.items():
            s.sort()
            assert s[0][0] == 0 and s[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        assert used(plan) >= -(-sum(k * v for k, v in counts.items()) // capacity)


def best(lengths, capacity):
    """Fewest bins, by trying everything."""
    found = [len(lengths)]

    def place(k, bins):
        if len(bins) >= found[0]:
            return
        if k == len(lengths):
            found[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1:])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return found[0]


def test_plan_near_the_fewest_bins():
    rnd = random.Random(4)
    over = 0
    for _ in range(40):
        lengths = sorted((rnd.randint(1, 12) for _ in range(8)), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        fewest = best(lengths, 12)
        assert used(plan_bins(counts, 12)) <= fewest + 1
        over += used(plan_bins(counts, 12)) > fewest
    assert over <= 4


def test_exact_fills_use_every_gap():
    assert used(plan_bins({7: 10, 3: 10}, 10)) == 10
    assert used(plan_bins({5: 4, 2: 4, 3: 4}, 10)) == 4
    assert used(plan_bins({4: 3, 3: 3, 2: 3, 1: 3}, 10)) == 3
    assert used(plan_bins({2048: 10**12, 1: 3}, 2048)) == 10**12 + 1
