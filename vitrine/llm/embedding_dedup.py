"""Embedding near-dedup with an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codewords is a cell
of the product grid, and a vector lives in the cell of its nearest codewords.
Searching visits cells in the order of the summed distances of both halves (the
multi-sequence order) -- as many as a sample of queries, held against all rows
by brute force, needs for ``RECALL`` of its links.  Vectors that meet in a cell
are verified by their cosine in double precision.

Equal vectors are one row with a weight before anything is compared.  Members
and queries of a cell travel in blocks of bounded size, so a crowded cell is
many tasks, and none of its members is left out.  A block pair returns counts
and a spanning set of its links, never all pairs.

Bounds (documented, of the index only): codebooks are fitted on at most
``SAMPLE_PER_WORD`` vectors per codeword, the number of visited cells on
``PROBES`` queries.  Every row is indexed and searched.

Defined cases: null or zero vectors, and vectors with null or non-finite
components, link with nothing; vectors of different lengths do not link; a null
id links with nothing and has no component; rows that repeat an id count as
separate vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.operators.lineage import materialize

COSINE, RECALL = 0.95, 0.999
#: Times as many cells are visited as the sampled queries needed, for links that the sample does not show.
SLACK = 4
#: Vectors per cell aimed at, codewords per half at most, sample per codeword, probing queries, vectors per block.
PER_CELL, MOST_WORDS, SAMPLE_PER_WORD, PROBES, BLOCK = 32, 512, 64, 1000, 256


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, size, vec): float64 bytes and their digest; vec is null where a vector cannot link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, raw = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.array([np.nan if x is None else x for x in value or ()], np.float64) + 0.0
                with np.errstate(over="ignore"):
                    ok = key is not None and len(v) and np.isfinite(v).all() and 0 < np.abs(v).max()
                if ok:
                    v = v / np.abs(v).max()
                    v = v / np.sqrt(v @ v)
                blob = v.tobytes() if ok else None
                keys.append(hashlib.blake2b(blob, digest_size=16).digest() if ok else None)
                sizes.append(len(v))
                raw.append(blob)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())],
                ["id", "key", "size", "vec"])

    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .mapInArrow(read, "id long, key binary, size int, vec binary"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of float64 bytes as a matrix, padded with zeros to ``dim``."""
    out = np.zeros((len(column), dim))
    for k, blob in enumerate(column):
        v = np.frombuffer(blob, np.float64)
        out[k, :len(v)] = v
    return out


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ words.T + (words ** 2).sum(1)[None, :], 0)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spread rows; an empty codeword stays where it was."""
    words = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, words).argmin(1)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=size)
        words[count > 0] = total[count > 0] / count[count > 0][:, None]
    return words


class MultiIndex:
    """Two codebooks and the order in which a query visits the cells of their grid."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = max(1, sample.shape[1] // 2)
        self.words = [codebook(sample[:, :self.half], size), codebook(sample[:, self.half:], size)]
        self.size = size

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :self.half], self.words[0]), distances(x[:, self.half:], self.words[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.both(x)
        return a.argmin(1) * self.size + b.argmin(1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Place of a cell in the visiting order of each row of x."""
        a, b = self.both(x)
        row = np.arange(len(x))
        reach = a[row, cells // self.size] + b[row, cells % self.size]
        b = np.sort(b, axis=1)
        return np.array([np.searchsorted(b[k], reach[k] - a[k], side="left").sum() for k in row])

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` cells of the multi-sequence order for every row of x.

        The cell of the i-th and j-th nearest codewords cannot come before place i * j."""
        a, b = self.both(x)
        reach = min(cells, self.size)
        near_a = np.argsort(a, axis=1, kind="stable")[:, :reach]
        near_b = np.argsort(b, axis=1, kind="stable")[:, :reach]
        i, j = np.nonzero((np.arange(reach)[:, None] + 1) * (np.arange(reach)[None, :] + 1) <= cells)
        total = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, :cells]
        cell = near_a[:, i] * self.size + near_b[:, j]
        return np.take_along_axis(cell, first, 1)


def fit_index(rows: DataFrame, count: int, dim: int) -> MultiIndex:
    size = int(np.clip(np.sqrt(count / PER_CELL), 1, MOST_WORDS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_WORD * size).select("vec").toPandas()
    return MultiIndex(matrix(sample["vec"], dim), min(size, len(sample)))


def cells_for_recall(rows: DataFrame, index, dim: int, cosine: float, recall: float) -> int:
    """Cells to visit: sampled queries against all rows, and where their links' cells stand in the order."""
    probes = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(PROBES).select("id", "vec").toPandas()
    asked = rows.sparkSession.sparkContext.broadcast((probes["id"].to_numpy(), matrix(probes["vec"], dim)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        for batch in batches:
            x = matrix(batch.column("vec").to_pylist(), dim)
            home = index.value.home(x)
            k, m = np.nonzero(q @ x.T >= cosine)
            other = ids[k] != batch.column("id").to_numpy()[m]
            k, m = k[other], m[other]
            for at in range(0, len(k), 4096):
                place = index.value.ranks(q[k[at:at + 4096]], home[m[at:at + 4096]])
                place, n = np.unique(place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 ["place", "n"])

    found = (rows.select("id", "vec").mapInArrow(places, "place long, n long")
             .groupBy("place").agg(F.sum("n").alias("n")).toPandas().sort_values("place"))  # a row per cell at most
    if not len(found):
        return SLACK
    enough = np.searchsorted(found["n"].cumsum(), recall * found["n"].sum(), side="left")
    return SLACK * (int(found["place"].iloc[min(enough, len(found) - 1)]) + 1)


def in_blocks(rows: DataFrame, cell: str) -> DataFrame:
    """(cell, rows): the rows of a cell in lists of about BLOCK; a crowded cell has many lists."""
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("crowd"))
    lists = F.pmod(F.xxhash64("id"), F.ceil(F.col("crowd") / BLOCK))
    return (rows.join(sizes, cell).groupBy(F.col(cell).alias("cell"), lists.alias("list"))
            .agg(F.collect_list(F.struct("id", "weight", "size", "vec", "home", "visits")).alias("rows")))


def spanning(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links of ``mask`` connect: (id, smallest id)."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(mask, b[None, :], top).min(1))
        new_b = np.minimum(b, np.where(mask, new_a[:, None], top).min(0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    ids, to = np.concatenate([left, right]), np.concatenate([a, b])
    return ids[to < ids], to[to < ids]


def verify(pairs: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(id, add, other): weights of linked vectors to add, or links (other) for the components."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("held")):
                q, m = asked.values, held.values
                qid, mid = q.field("id").to_numpy(), m.field("id").to_numpy()
                qw, mw = q.field("weight").to_numpy(), m.field("weight").to_numpy()
                x = matrix(q.field("vec").to_pylist(), dim)
                y = matrix(m.field("vec").to_pylist(), dim)
                mask = (x @ y.T >= cosine) & (qid[:, None] != mid[None, :])
                mask &= q.field("size").to_numpy()[:, None] == m.field("size").to_numpy()[None, :]
                if not mask.any():
                    continue
                add = mask @ mw
                # a member that does not visit the query's cell learns of the link here
                back = np.zeros(len(mid), np.int64)
                visits = np.array(m.field("visits").to_pylist(), np.int64)
                for k in np.flatnonzero(mask.any(1)):
                    blind = mask[k] & ~(visits == q.field("home")[int(k)].as_py()).any(1)
                    back[blind] += qw[k]
                one, two = spanning(mask, qid, mid)
                ids = np.concatenate([qid[add > 0], mid[back > 0], one])
                more = np.concatenate([add[add > 0], back[back > 0], np.zeros(len(one), np.int64)])
                other = np.concatenate([qid[add > 0], mid[back > 0], two])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(more), pa.array(other)], ["id", "add", "other"])

    return pairs.mapInArrow(test, "id long, add long, other long")


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    rows = materialize(vectors(df, id_col, vec_col), "vectors")
    linking = rows.filter("vec is not null")
    equal = materialize(linking.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"),
                                                   F.first("size").alias("size"), F.first("vec").alias("vec")), "equal")
    count, dim = equal.agg(F.count(F.lit(1)), F.max("size")).first()
    nothing = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not count:
        return nothing.withColumn("kept", F.lit(True))
    context = df.sparkSession.sparkContext
    index = context.broadcast(fit_index(equal, count, dim))
    cells = cells_for_recall(equal, index, dim, cosine, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec").to_pylist(), dim)
            seen = index.value.visits(x, cells) if len(x) else np.zeros((0, 1), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * seen.shape[1]),
                                             pa.array(seen.ravel()))
            home = index.value.home(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "weight", "size", "vec")],
                                              pa.array(home), lists], ["id", "weight", "size", "vec", "home", "visits"])

    placed = materialize(equal.select("id", "weight", "size", "vec")
                         .mapInArrow(place, "id long, weight long, size int, vec binary, home long, visits array<long>"), "placed")
    held = in_blocks(placed, "home").select("cell", F.col("rows").alias("held"))
    asked = in_blocks(placed.withColumn("seen", F.explode("visits")), "seen").select("cell", F.col("rows").alias("asked"))
    found = materialize(verify(asked.join(held, "cell"), dim, cosine), "found")
    added = found.groupBy("id").agg(F.sum("add").alias("links"))
    labels = components(found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = (equal.select("key", "id", "weight").join(added, "id", "left").join(labels, "id", "left")
             .select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id")))
    out = rows.select("id", "key").filter("key is not null").join(known, "key").select("id", "n_links", "component_id")
    rest = (rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, cast(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT vec_id AS origin, vec_id AS place FROM vectors
  UNION SELECT origin, b FROM reach JOIN links ON links.a = reach.place),
labels AS (SELECT origin AS vec_id, min(place) AS component_id FROM reach GROUP BY origin)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id IS NOT DISTINCT FROM coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN labels USING (vec_id)
"""
