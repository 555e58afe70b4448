"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary answers a whole pre-token
that is a token already.  Tier two, for the misses: a heap of adjacent pairs
over a linked list of bytes, lowest rank first and leftmost on ties.  The hash
table has the size of the vocabulary, is built once and broadcast.

White space and the text around it split independently of each other, so a run
without white space, with the blank before it, is kept with its ids in each
worker (a bounded memory that starts anew when full).

Defined cases: null and empty texts have no ids; rows that repeat an id are
separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.workers import held

#: Entries kept in each worker's memory of runs and of pre-tokens.
CACHE_RUNS = 1_900_000
#: Unicode White_Space, as the pre-token pattern reads \s.
BLANK = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]").findall
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Hash and displace: a slot of its own for each of n keys in a table of n slots."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 2):
        import xxhash

        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        slots: list[int | None] = [None] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) == 1:  # the last ones take what is left, by the slot itself
                while slots[free] is not None:
                    free += 1
                slots[free], self.shift[b] = group[0], -free - 1
            elif group:
                d = 0
                while True:
                    at = {self._at(hashes[i], d) for i in group}
                    if len(at) == len(group) and all(slots[s] is None for s in at):
                        break
                    d += 1
                for i in group:
                    slots[self._at(hashes[i], d)] = i
                self.shift[b] = d
        self.keys = [keys[i] if i is not None else b"" for i in slots]
        self.values = [values[i] if i is not None else -1 for i in slots]

    def _at(self, h: int, d: int) -> int:
        return ((h >> 33) + d * ((h & 0xFFFFFF) | 1) + d * d) % self.n

    def get(self, key: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        at = -d - 1 if d < 0 else self._at(h, d)
        return self.values[at] if self.keys[at] == key else -1


def byte_pairs(ranks: dict[bytes, int]) -> list[int | None]:
    """Rank of every pair of single bytes, by first * 256 + second."""
    return [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]


def merge(token: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> list[int]:
    """Ids of a pre-token that is no token itself."""
    n = len(token)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged into the part before
    before = list(range(-1, n))
    rank = ranks.get
    heap = [(r, i, i + 2) for i, (a, b) in enumerate(zip(token, token[1:])) if (r := pairs[a << 8 | b]) is not None]
    pop, push = heapq.heappop, heapq.heappush
    heapq.heapify(heap)
    while heap:
        _, i, stop = pop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:  # one of its parts has changed since
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(token[i:end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := rank(token[left:stop])) is not None:
            push(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i:end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, table: PerfectHash, pattern: str, limit: int = CACHE_RUNS):
        import regex

        self.table = table
        self.split = regex.compile(pattern).findall
        self.ranks = dict(zip(table.keys, table.values))
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pairs = byte_pairs(self.ranks)
        self.limit = limit
        self.pre: dict[str, list[int]] = {}
        self.runs: dict[str, tuple[str, int, bytes]] = {}

    def pre_token(self, text: str) -> list[int]:
        ids = self.pre.get(text)
        if ids is None:
            raw = text.encode()
            whole = self.table.get(raw)
            ids = [whole] if whole >= 0 else merge(raw, self.ranks, self.pairs)
            if len(self.pre) >= self.limit * 2 // 3:
                self.pre.clear()
            self.pre[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.pre_token(part)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def run(self, text: str) -> tuple[str, int, bytes]:
        """Ids as text, their number, and what they decode to."""
        ids = self.encode(text)
        found = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(self.runs) >= self.limit:
            self.runs.clear()
        self.runs[text] = found
        return found

    def text(self, text: str) -> list[tuple[str, int, bytes]]:
        known, run = self.runs.get, self.run
        return [known(x) or run(x) for x in _RUNS(text)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; the ids' text is comma-separated decimals."""
    ranks = load_ranks(ranks_path)
    table = df.sparkSession.sparkContext.broadcast(PerfectHash(list(ranks), list(ranks.values())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("byte coder", ranks_path, pattern), lambda: ByteBpe(table.value, pattern))
        collects = gc.isenabled()
        gc.disable()  # millions of kept runs and no cycles: each collection would walk them all
        try:
            yield from coded(coder, batches)
        finally:
            if collects:
                gc.enable()

    def coded(coder: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                runs = coder.text(text.as_py() or "")
                count.append(sum([r[1] for r in runs]))
                ids_sha.append(hashlib.sha256(",".join([r[0] for r in runs]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join([r[2] for r in runs])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(encode, ENCODED))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
