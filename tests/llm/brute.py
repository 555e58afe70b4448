"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter
from math import log10

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def smallest(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:]
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    found = smallest(links, {i for i, _ in rows})
    return sorted((i, len(x), found[i]) for i, x in sets)


def repeated(rows, length=50):
    out, seen = [], set()
    for key in sorted({i for i, _ in rows}):
        own = []
        for i, text in rows:
            if i != key:
                continue
            raw = (text or "").encode()
            gone = bytearray(len(raw))
            for k in range(len(raw) - length + 1):
                own.append(raw[k:k + length])
                if raw[k:k + length] in seen:
                    gone[k:k + length] = b"\1" * length
            out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                        bytes(c for c, g in zip(raw, gone) if not g)))
        seen.update(own)
    return sorted(out)


def unigrams(rows):
    """(id, tokens, known, N, base score) per row."""
    texts = [(i, [*words(t), None]) for i, t in rows]
    count = Counter(w for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    return [(i, len(t), sum(count[w] > 0 for w in t), n,
             sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in texts]
