"""Fill-in-the-middle transformation by secondary sort.

A document becomes pieces of at most ``CHUNK`` code points, keyed by document and
place in the output.  ``repartition`` by document and ``sortWithinPartitions`` by
(document, place) bring each output together in order, and one pass streams the
pieces of a partition: digests grow piece by piece, so no task ever holds a whole
text.  The same pass cuts the output at its marks again; sorting those pieces by
(document, part, place) within the partitions, without another shuffle, restores
the text from the output and its form alone.

Output: plain (the text), psm ``<P>``prefix``<S>``suffix``<M>``middle, or spm
``<S>``suffix``<P>``prefix``<M>``middle.  Cuts and form follow from the SHA-256 of
"<seed>:<id>", so every run gives the same.

Defined cases: a null text is empty, and an empty text is plain; a text that holds a
mark is plain; a null id counts as the empty string in the hash; rows that repeat
an id are documents of their own; an empty table gives no rows; other columns are
never read.  The input's rows must come in the same order when a task runs again, as
those of a table do (write other inputs first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.textops import text_blocks

#: Code points of a piece at most.
CHUNK = 4096
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts in each form, and of the text.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")
#: Pieces of a task's output batch.
ROWS = 1024

HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"doc long, place long, piece binary, {HEAD}"
CUT = f"doc long, part int, place long, piece binary, {HEAD}, output_sha256 string"


@dataclass(frozen=True)
class Settings:
    """Per cent of documents that are transformed, per cent of those in spm form, and the hash's seed."""

    rate: int = 90
    spm_rate: int = 20
    seed: str = "1"


def plan(key, n: int, marked: bool, settings: Settings) -> tuple[str, int, int]:
    """Form of a document of n code points, and the places where its prefix and middle end."""
    digest = hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))
    if not n or marked or h3 % 100 >= settings.rate:
        return "plain", 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < settings.spm_rate else "psm", first, second


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])


def fim_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Pieces of the outputs (doc, place, piece); the piece at place 0 carries the document's facts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = _schema(PIECES), []
        for batch in batches:
            numbers, done = batch.column("doc").to_pylist(), 0
            for ids, buf, off in text_blocks([batch], "doc_id", "text"):
                for k, key in enumerate(ids.to_pylist()):
                    raw = buf[off[k]:off[k + 1]]
                    text, at = raw.tobytes(), None  # at: bytes where code points begin, None if every byte is one
                    if not text.isascii():
                        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    n = len(text) if at is None else len(at) - 1
                    form, first, second = plan(key, n, any(m in text for m in MARKS.values()), settings)
                    head = (key, n, form) + ((None, None) if form == "plain" else (first, second - first))
                    bounds = {"prefix": (0, first), "middle": (first, second), "suffix": (second, n)}
                    parts = [(b"", (0, n))] if form == "plain" else [(MARKS[p], bounds[p]) for p in FORMS[form]]
                    place = 0
                    for mark, (start, end) in parts:
                        for u in range(start, max(end, start + 1), CHUNK):
                            v = min(u + CHUNK, end)
                            piece = text[u:v] if at is None else text[at[u]:at[v]]
                            rows.append((numbers[done + k], place, mark + piece if u == start else piece,
                                         *(head if not place else (None,) * 5)))
                            place += 1
                    if len(rows) >= ROWS:
                        yield _batch(rows, schema)
                        rows = []
                done += len(ids)
        if rows:
            yield _batch(rows, schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"),
                           F.col(text_col).alias("text"))
    return numbered.mapInArrow(cut, PIECES)


def in_order(pieces: DataFrame) -> DataFrame:
    """The secondary sort: a document's pieces in one partition, in the output's order."""
    return pieces.repartition("doc").sortWithinPartitions("doc", "place")


class _Cutter:
    """Cuts a stream of output bytes at the marks of its form; a mark may lie across pieces."""

    def __init__(self, form: str):
        self.marks = [(MARKS[p], PARTS.index(p)) for p in FORMS.get(form, ())][::-1]
        self.part, self.kept = 0, b""

    def add(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.kept + piece
        while self.marks and (found := data.find(self.marks[-1][0])) >= 0:
            if found:
                yield self.part, data[:found]
            mark, self.part = self.marks.pop()
            data = data[found + len(mark):]
        keep = min(2, len(data)) if self.marks else 0  # the rest may begin a mark
        self.kept = data[len(data) - keep:]
        if len(data) > keep:
            yield self.part, data[:len(data) - keep]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.kept:
            yield self.part, self.kept


def _documents(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def restoring(ordered: DataFrame) -> DataFrame:
    """Digest of each output, and its pieces again, cut at the marks: part 0 to 2 in the text's order.

    A row of part -1 carries the document's facts and the digest of its output."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, doc, place = _schema(CUT), [], None, 0
        nothing = (None,) * 6

        def close() -> None:
            rows.extend((doc, part, place + k, piece, *nothing) for k, (part, piece) in enumerate(cutter.end()))
            rows.append((doc, -1, 0, None, *head, digest.hexdigest()))

        for own, piece, *facts in _documents(batches, ("doc", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars")):
            if own != doc:
                if doc is not None:
                    close()
                doc, place, head, digest, cutter = own, 0, facts, hashlib.sha256(), _Cutter(facts[2])
            digest.update(piece)
            for part, cut in cutter.add(piece):
                rows.append((doc, part, place, cut, *nothing))
                place += 1
            if len(rows) >= ROWS:
                yield _batch(rows, schema)
                rows.clear()
        if doc is not None:
            close()
        if rows:
            yield _batch(rows, schema)

    return ordered.mapInArrow(stream, CUT)


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per document."""
    fields = f"{HEAD}, output_sha256 string, restored_sha256 string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, doc = _schema(fields), [], None
        columns = ("doc", "part", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
        for own, part, piece, *facts in _documents(batches, columns):
            if own != doc:
                if doc is not None:
                    rows.append((*head, digest.hexdigest()))
                doc, head, digest = own, facts, hashlib.sha256()
                if len(rows) >= ROWS:
                    yield _batch(rows, schema)
                    rows = []
            if part >= 0:
                digest.update(piece)
        if doc is not None:
            rows.append((*head, digest.hexdigest()))
        if rows:
            yield _batch(rows, schema)

    # a document stays in its partition, so sorting it anew needs no exchange
    return cut.sortWithinPartitions("doc", "part", "place").mapInArrow(stream, fields)


def fim_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per document: the transformed texts themselves."""
    fields = f"{HEAD}, output string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, doc, held = _schema(fields), None, []
        for own, piece, *facts in _documents(batches, ("doc", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars")):
            if own != doc:
                if doc is not None:
                    yield _batch([(*head, b"".join(held).decode())], schema)
                doc, head, held = own, facts, []
            held.append(piece)
        if doc is not None:
            yield _batch([(*head, b"".join(held).decode())], schema)

    return in_order(fim_pieces(docs, id_col, text_col, settings)).mapInArrow(stream, fields)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(restoring(in_order(fim_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))))


OP12_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
