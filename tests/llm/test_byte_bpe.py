import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from vitrine.llm.byte_bpe import ByteBpe, PerfectHash, byte_bpe, byte_pairs, load_ranks, merge

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(ranks):
    table = PerfectHash(list(ranks), list(ranks.values()))
    assert len(table.keys) == len(ranks) and sorted(table.values) == sorted(ranks.values())
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"\xff\xfe no token \x00") == -1


def test_merge_of_misses(ranks, plain):
    rnd, pairs = random.Random(1), byte_pairs(ranks)
    for _ in range(300):
        word = bytes(rnd.choice(b"abetion\xc3\xa9\xff ") for _ in range(rnd.randint(1, 30)))
        assert merge(word, ranks, pairs) == plain._core_bpe.encode_single_piece(word)


def test_encode_and_decode(ranks, plain):
    rnd = random.Random(3)
    letters = " \t\n\r\x0b\x1c\x1f\x85\xa0  ab'sé1²½٣_-.😀ßʼn中"
    coder = ByteBpe(PerfectHash(list(ranks), list(ranks.values())), public_tokenizers.PATTERN, limit=64)
    for text in ["", "a" * 3000, " " * 500, *["".join(rnd.choices(letters, k=rnd.randint(0, 50))) for _ in range(500)]]:
        runs = coder.text(text)
        assert ",".join(r[0] for r in runs) == ",".join(map(str, plain.encode_ordinary(text)))
        assert b"".join(r[2] for r in runs) == text.encode() == coder.decode(coder.encode(text))


def test_cases(table, plain):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "ab " * 30_000), (1, "again"), (None, "null id")]
    want = []
    for key, text in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    out = byte_bpe(table(rows), PATH, public_tokenizers.PATTERN)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert byte_bpe(table([]), PATH, public_tokenizers.PATTERN).count() == 0
