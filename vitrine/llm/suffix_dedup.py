"""Substring dedup by longest-previous-factor arrays.

A byte is removed when a string of ``length`` bytes around it also starts in a
document with a smaller id.  Suffixes are sorted in parts that cannot split a
match: every window of ``length`` bytes belongs to its minimiser (the smallest
hash among its ``seed``-byte strings), equal windows have equal minimisers, and
neighbouring windows with the same one travel as one fragment.

1. Texts are packed into compressed blocks, written once, bucketed by block.
2. Each block reports its distinct minimisers; those that are found in one
   document only cannot hold a match and end here.
3. Fragments of the others go to the part of their minimiser.  A fragment that
   repeats within a block goes once, for its smallest document; its other
   documents are settled by that one.
4. Each part sorts its window starts into suffix order, takes the common
   prefixes of neighbours, and finds for each the previous and next suffix of a
   smaller document: the longest previous factor reaches ``length`` if one of
   both does.
5. Covered ranges go back to the blocks, which cut their texts.

Parts are sized by the bytes of the input, so none grows with it; a very common
passage reaches its part once per block.

Defined cases: null and empty texts lose nothing; rows that repeat an id are one
document in the comparison (none removes from another) and each is returned;
null ids come after all others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.textops import prefix_hash, powers, mix, ragged, text_blocks
from vitrine.llm.workers import tidy

LENGTH, SEED = 50, 20
#: Bytes of text per block, and per part of the seed and of the fragment exchange.
BLOCK, SEED_PART, FRAGMENT_PART = 1 << 21, 1 << 26, 1 << 22
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
LAST = (1 << 63) - 1


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, ends, text, bytes): texts of up to BLOCK bytes in one compressed row; longer texts alone."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        held_ids, held_text, held_len, size = [], [], [], 0

        def row():
            name = uuid.uuid4().int & LAST
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([press.compress(np.concatenate(held_ids).tobytes())], pa.binary()),
                 pa.array([press.compress(np.concatenate(held_len).astype(np.int64).tobytes())], pa.binary()),
                 pa.array([press.compress(b"".join(held_text))], pa.binary()), pa.array([size])],
                ["block", "ids", "ends", "text", "bytes"])

        for ids, buf, off in text_blocks(batches, "id", "text", BLOCK):
            if size and size + len(buf) > BLOCK:
                yield row()
                held_ids, held_text, held_len, size = [], [], [], 0
            held_ids.append(ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64))
            held_text.append(buf.tobytes())
            held_len.append(np.diff(off))
            size += len(buf)
        if held_ids:
            yield row()

    return docs.mapInArrow(pack, "block long, ids binary, ends binary, text binary, bytes long")


def unpack_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a block."""
    open_ = zstandard.ZstdDecompressor().decompress
    ids = np.frombuffer(open_(row["ids"]), np.int64)
    off = np.concatenate([[0], np.cumsum(np.frombuffer(open_(row["ends"]), np.int64))])
    return ids, np.frombuffer(open_(row["text"]), np.uint8), off


def fragments(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """(minimiser, first byte, bytes, row) of every run of windows that share a minimiser.

    Works in stretches of 2**23 bytes that overlap by a window, so a very long text needs no more memory."""
    out = []
    stretch = 1 << 23
    for base in range(0, max(1, len(buf) - length + 1), stretch):
        part = buf[base:base + stretch + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        prefix = prefix_hash(part)
        _, inverse = powers(len(prefix))
        at = np.arange(len(part) - seed + 1)
        value = mix((prefix[at + seed] - prefix[at]) * inverse[at])
        value = (value & ~_PLACE) | at.astype(_U)  # the leftmost of equal ones
        width, done = length - seed + 1, 1
        while done < width:  # smallest of the window, by doubling
            step = min(done, width - done)
            value = np.minimum(value[:-step], value[step:])
            done += step
        start = np.arange(n) + base
        row = np.searchsorted(off, start, side="right") - 1
        inside = start + length <= off[row + 1]
        value, start, row = value[:n][inside], start[inside], row[inside]
        if not len(value):
            continue
        edge = np.ones(len(value), bool)
        edge[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(edge)
        runs = np.diff(np.append(first, len(value)))
        out.append((value[first] >> _U(24), start[first], runs + length - 1, row[first]))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def spread(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def seeds_by_part(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, seeds, n, local): distinct minimisers of a block, flagged if two of its documents hold them."""

    @tidy
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, buf, off = unpack_block(row)
                key, _, _, doc = fragments(buf, off)
                order = np.lexsort((ids[doc], key, key % _U(parts)))
                key, doc = key[order], ids[doc][order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                last = np.append(first[1:], len(key)) - 1
                several = doc[first] != doc[last]
                key = key[first]
                part = (key % _U(parts)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(key) else [0]
                rows = [(int(part[i]), row["block"], squeeze(np.diff(key[i:j], prepend=_U(0))), squeeze(several[i:j]))
                        for i, j in zip(cut[:-1], cut[1:])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        ["part", "block", "seeds", "several"])

    return blocks.mapInArrow(report, "part long, block long, seeds binary, several binary")


def common_seeds(reports: DataFrame) -> DataFrame:
    """(block, seeds): of each report, the minimisers that two documents hold, anywhere."""

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(spread(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("seeds")]
        flags = [spread(x.as_py(), bool) for x in table.column("several")]
        names = table.column("block").to_pylist()
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every, flag = every[order], np.concatenate(flags)[order]
        edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        size = np.diff(np.append(edge, len(every)))
        shared = (size > 1) | np.logical_or.reduceat(flag, edge)
        hit = np.zeros(len(every), bool)
        hit[order] = np.repeat(shared, size)
        at = np.cumsum([0] + [len(x) for x in lists])
        out = [(b, squeeze(np.diff(x[hit[i:j]], prepend=_U(0))))
               for b, x, i, j in zip(names, lists, at[:-1], at[1:]) if hit[i:j].any()]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()),
                         "common": pa.array([o[1] for o in out], pa.binary())})

    return reports.groupBy("part").applyInArrow(meet, "block long, common binary")


SPANS = "block long, row long, first long, bytes long"


def fragments_by_part(blocks: DataFrame, common: DataFrame, parts: int) -> DataFrame:
    """Fragments of common minimisers by part (kind 0); ranges settled within their block (kind 1) go with any part."""

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, buf, off = unpack_block(row)
                key, start, size, doc = fragments(buf, off)
                wanted = np.sort(np.concatenate([np.cumsum(spread(x, np.uint64), dtype=np.uint64) for x in row["common"]]))
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = wanted[at] == key
                key, start, size, doc = key[hit], start[hit], size[hit], doc[hit]
                prefix = prefix_hash(buf)
                _, inverse = powers(len(prefix))
                name = mix((prefix[start + size] - prefix[start]) * inverse[start] + size.astype(_U))
                owner = ids[doc]
                order = np.lexsort((owner, name, key))
                key, start, size, owner, doc, name = (v[order] for v in (key, start, size, owner, doc, name))
                new = np.ones(len(key), bool)
                new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
                smallest = owner[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                settled = owner > smallest
                if settled.any():
                    yield made(1, row["block"] % parts, row["block"], owner[settled], doc[settled], start[settled], size[settled], b"")
                key, start, size, owner, doc = (v[~settled] for v in (key, start, size, owner, doc))
                part = (key % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, start, size, owner, doc = (v[order] for v in (part, start, size, owner, doc))
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
                for i, j in zip(cut[:-1], cut[1:]):
                    text = buf[ragged(start[i:j], size[i:j])].tobytes()
                    yield made(0, int(part[i]), row["block"], owner[i:j], doc[i:j], start[i:j], size[i:j], text)

    def made(kind, part, block, owner, doc, place, size, text):
        numbers = [pa.array([squeeze(v.astype(np.int64))], pa.binary()) for v in (owner, doc, place, size)]
        return pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([block], pa.int64()), *numbers,
             pa.array([zstandard.compress(text, 3)], pa.binary())],
            ["kind", "part", "block", "owner", "row", "place", "size", "text"])

    return (blocks.join(common.groupBy("block").agg(F.collect_list("common").alias("common")), "block")
            .mapInArrow(send, "kind int, part long, block long, owner binary, row binary, place binary, size binary, "
                              "text binary"))


def nearest_smaller(doc: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a previous entry, not before ``bound``, has a smaller document (pointer jumping)."""
    here = np.arange(len(doc)) - 1
    open_ = np.flatnonzero(here >= bound)
    found = np.zeros(len(doc), bool)
    while len(open_):
        to = here[open_]
        less = doc[to] < doc[open_]
        found[open_[less]] = True
        open_, to = open_[~less], to[~less]
        here[open_] = np.minimum(here[to], to - 1)
        here[open_[found[open_]]] = -1
        open_ = open_[here[open_] >= bound[open_]]
    return found


def previous_factors(text: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the longest previous factor of a window start reaches ``length``.

    Suffixes are compared by their first ``length`` bytes, which is all the answer depends on."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    window = np.ascontiguousarray(view[start])
    order = np.argsort(window.view(f"S{length}").ravel(), kind="stable")
    window, doc = window[order], doc[order]
    n = len(order)
    same = np.zeros(n, bool)  # the common prefix with the suffix before is `length` bytes or more
    same[1:] = (window[1:] == window[:-1]).all(axis=1)
    run = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    before = nearest_smaller(doc, run)
    ends = np.append(np.flatnonzero(~same)[1:], n)
    stop = np.repeat(ends, np.diff(np.append(np.flatnonzero(~same), n)))
    after = nearest_smaller(doc[::-1], (n - stop)[::-1])[::-1]
    out = np.zeros(n, bool)
    out[order] = before | after
    return out


def covered(sent: DataFrame) -> DataFrame:
    """(block, row, first, bytes): ranges of a block's texts that a smaller document covers."""

    def ranges(block, row, first, size) -> pa.Table:
        return pa.table({"block": pa.array(block, pa.int64()), "row": row, "first": first, "bytes": size})

    def numbers(table: pa.Table, names: str) -> list[np.ndarray]:
        return [np.concatenate([spread(x.as_py(), np.int64) for x in table.column(c)]) for c in names.split()]

    def of_rows(table: pa.Table) -> np.ndarray:
        return np.repeat(table.column("block").to_numpy(), [len(spread(x.as_py(), np.int64)) for x in table.column("size")])

    def part(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done, table = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
        out = []
        if done.num_rows:
            out.append(ranges(of_rows(done), *numbers(done, "row place size")))
        if table.num_rows:
            owner, row, place, size = numbers(table, "owner row place size")
            block = of_rows(table)
            text = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in table.column("text")), np.uint8)
            at = np.cumsum(size) - size
            windows = size - LENGTH + 1
            start = ragged(at, windows)
            which = np.repeat(np.arange(len(size)), windows)
            hit = np.flatnonzero(previous_factors(text, start, owner[which]))
            which, start = which[hit], start[hit]
            new = np.ones(len(hit), bool)  # neighbouring windows of a fragment are one range
            new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
            edge = np.flatnonzero(new)
            which, first = which[edge], (place[which] + start - at[which])[edge]
            runs = np.diff(np.append(edge, len(hit)))
            out.append(ranges(block[which], row[which], first, runs + LENGTH - 1))
        return pa.concat_tables(out)

    return sent.groupBy("part").applyInArrow(part, SPANS)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, removed) per row: the bytes that stay, and the maximal removed ranges (first, bytes)."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = f"text_blocks_{uuid.uuid4().hex}"  # bucketed by block: answers come to the texts, which are not shuffled
    # as many as a shuffle has parts at least, else Spark shuffles the texts for more parts
    buckets = int(min(4096, max(least, total // (8 * BLOCK))))
    pack_blocks(docs).write.format("parquet").bucketBy(buckets, "block").saveAsTable(table)
    blocks = spark.table(table)
    common = common_seeds(seeds_by_part(blocks, max(least, total // SEED_PART + 1)))
    sent = fragments_by_part(blocks, common, max(least, total // FRAGMENT_PART + 1))  # one shuffle, no copy beside it
    ranges = covered(sent).groupBy("block").agg(
        F.collect_list(F.struct("first", "bytes")).alias("ranges"))  # of one block of bounded size

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                ids, buf, off = unpack_block({c: r.column(c)[0].as_py() for c in ("ids", "ends", "text")})
                open_ = np.zeros(len(buf) + 1, np.int64)
                if r.column("ranges")[0].is_valid:
                    found = r.column("ranges")[0].values
                    first, size = found.field("first").to_numpy(), found.field("bytes").to_numpy()
                    np.add.at(open_, first, 1)
                    np.add.at(open_, first + size, -1)
                gone = np.cumsum(open_)[:-1] > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                edge = off[:-1][off[:-1] < len(buf)]
                begin[edge] = gone[edge]
                start = np.flatnonzero(begin)
                count = np.concatenate([[0], np.cumsum(gone)])
                ends = np.append(start[1:], len(buf))
                owner = np.searchsorted(off, start, side="right") - 1
                stop = np.minimum(ends, off[owner + 1]) if len(start) else ends
                runs = pa.StructArray.from_arrays([pa.array(start - off[owner]), pa.array(count[stop] - count[start])],
                                                  ["first", "bytes"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, off).astype(np.int32)), runs)
                stay = buf[~gone].tobytes()
                at = off - count[off]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == LAST), pa.array([stay[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()),
                     lists.cast(kind)], ["id", "kept", "removed"])

    return blocks.join(ranges, "block", "left").mapInArrow(
        cut, "id long, kept binary, removed array<struct<first:long,bytes:long>>")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("kept") + removed).alias("n_bytes"),
                      removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
