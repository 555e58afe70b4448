"""Best-fit packing by exact-complement hashing.

Texts become token ids in Arrow tasks; only (length, count) -- at most
``capacity`` rows, whatever the input -- reaches the driver, which plans how
often each combination of lengths is used: lengths whose sums of one, two or
three parts exactly fill the gap left by a piece are consumed under their
counts, the rest goes best-fit decreasing.  Every piece then finds its place by
its rank among the pieces of its length, a join on bounded tables.

Defined cases: null and empty texts are one piece holding the separator; rows
that repeat an id are separate documents; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.workers import held
from vitrine.operators.lineage import materialize

CAPACITY = 2048
#: Words kept with their ids in each Python worker; beyond it the memory starts anew.
CACHE_WORDS = 800_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, slot long"


class WordTokenizer:
    """Ids of a word-level BPE file; pieces never cross white space, so words are kept with their ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = iter(range(256, 512))
        self.byte_char = {b: chr(b) if b in set(shown) else None for b in range(256)}
        self.byte_char = {b: c or chr(next(other)) for b, c in self.byte_char.items()}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.limit = cache_words

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            shown = "".join(self.byte_char[b] for b in part.encode())
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if len(self.words) >= self.limit:
            self.words.clear()
        if max(word) < "ɐ" and "İ" not in word:  # NFC leaves these alone; one lower-case letter each
            ids = b"".join(map(self._part, self.split(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # not white space here
            units = re.findall("[^\t-\r \x85\xa0  -     　]+", text)
        else:
            units = text.split()
        known, word = self.words.get, self._word
        return b"".join([known(u) or word(u) for u in units])


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker, kept for the worker's next tasks."""
    return held(("word tokenizer", path), lambda: WordTokenizer(path))


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids."""
    for at in range(0, len(ids), 4 * capacity):
        part = ids[at:at + 4 * capacity]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; (task, slot) counts the pieces of a length within a task."""
    end = int(separator).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(tokenizer_path).encode
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1)):
                for k, (start, length, crc) in enumerate(cut(encode(text.as_py() or "") + end, capacity)):
                    rows.append((key.as_py(), k, start, length, crc, task, seen[length]))
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "slot")
            cols = zip(*rows) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many bins hold just these) for all pieces; its size does not grow with the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(parts: tuple[int, ...]) -> bool:
        need = {p: parts.count(p) for p in parts}
        n = min(int(left[p]) // k for p, k in need.items())
        if n <= 0:
            return False
        for p, k in need.items():
            left[p] -= n * k
        plan.append((parts, n))
        return True

    def complement(gap: int, parts: int):
        """Available lengths that sum to ``gap``, the largest first; parts of 1, 2 or 3."""
        if parts == 1:
            return (gap,) if gap > 0 and left[gap] > 0 else None
        if parts == 2:
            big = np.arange(gap - 1, (gap - 1) // 2, -1)
            ok = np.flatnonzero((left[big] > 0) & (left[gap - big] > 0) & ((big * 2 != gap) | (left[big] > 1)))
            return (int(big[ok[0]]), int(gap - big[ok[0]])) if len(ok) else None
        for b in np.flatnonzero(left[:gap] > 0)[::-1]:
            if b * 3 < gap:
                return None
            left[b] -= 1
            rest = complement(int(gap - b), 2)
            left[b] += 1
            if rest and rest[0] <= b:
                return (int(b), *rest)
        return None

    if left[capacity]:
        consume((capacity,))
    for parts in (1, 2, 3):  # exact fills with few parts first: they save the small pieces for later gaps
        for a in range(capacity - 1, 0, -1):
            while left[a] > 0:
                left[a] -= 1
                rest = complement(capacity - a, parts)
                left[a] += 1
                if not rest or not consume((a, *rest)):
                    break
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            room = min((r for r, b in open_bins.items() if r >= a and b), default=capacity)
            if room == capacity and not open_bins.get(capacity):
                held, bins = (), -(-n // (capacity // a))
            else:
                held, bins = open_bins[room].pop()
            each = room // a
            full = min(bins, n // each)
            if full:
                open_bins.setdefault(room - each * a, []).append((held + (a,) * each, full))
                n, bins = n - full * each, bins - full
            if bins and n:
                some = min(n, each)
                open_bins.setdefault(room - some * a, []).append((held + (a,) * some, 1))
                n, bins = n - some, bins - 1
            if bins and held:
                open_bins.setdefault(room, []).append((held, bins))
    return plan + [b for group in open_bins.values() for b in group]


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the ranks of a length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for parts, n in plan:
        offset = 0
        for p in parts:
            out.append((p, used.get(p, 0), used.get(p, 0) + n, sequence, offset))
            used[p] = used.get(p, 0) + n
            offset += p
        sequence += n
    return out


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset; every sequence holds at most ``capacity`` ids."""
    spark = df.sparkSession
    pieces = materialize(token_pieces(df, tokenizer_path, capacity, separator, id_col, text_col), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(places(plan_bins(counts, capacity)),
                                  "length long, low long, high long, sequence long, offset long")
    ranked = pieces.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("slot"))
    # the plan has a bounded number of rows per capacity, not per document
    return (ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("low"))
                        & (F.col("rank") < F.col("high")))
            .select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                    (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
