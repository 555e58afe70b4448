"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct five-word shingles.  In one order of all
shingles, two sets that meet the threshold share at least k shingles within
their first ``n - ceil(t n) + k``: their prefixes (k grows with the size, so a
phrase shared by chance leads nowhere).  Documents of equal size and prefix form
one group; only group leaders are matched by shared prefix shingles, pairs of
groups are filtered by size and by the place of a shared shingle (the sets must have
room for the overlap from there on), and the rest is expanded to the distinct
sets of the groups and verified on whole sets.

The order puts shingles that many documents hold last.  What is common is told
by a count sketch of fixed size; any sketch gives right results, because any
order does -- it only decides how short the lists of candidates are.

Links are found in rounds.  First every set is verified against the
leader that it shares most lists with, then against the leaders of its lists
that are still in another component, then against pivots, a few sets of each
list taken by hash, which joins large groups of near copies without all their
pairs, whether or not one set is near all others; then, of the remaining pairs
of a list between two components, the one whose sets seem closest; last, every
remaining pair whose sets are not yet in one component.  Lists of the same groups count as one there, and
pairs are told apart by parity maps of their sets: sets that differ in d
shingles differ in at most d bits.  No link between components is lost, and no
list, pair or set is capped.  New links join components, not all links again.

Defined cases: null and empty texts, and texts without words, have no shingles
and link with nothing; fewer than five words are one shingle; rows that repeat
an id take part one by one and share their id's component; null ids are left out;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.components import components, joined
from vitrine.llm.textops import LOWER, mix, prefix_hash, span_hash, text_blocks, words
from vitrine.llm.workers import tidy
from vitrine.operators.lineage import materialize

WORDS, PERCENT = 5, 80
#: Size of the count sketch (2**bits cells) and of the filter of wanted ids.
SKETCH_BITS, FILTER_BITS = 18, 23
#: One more shared prefix shingle is asked for per so many shingles of a set.
SHARE_STEP = 32
#: Sets of every list that its other sets are verified against before all pairs are.
PIVOTS = 4
#: 64-bit words of a set's parity map.
MAP_WORDS = 16
#: Shingles that a task counts together before it passes on the repeated ones.
COUNTED = 1 << 22
#: Text that a task takes up at once.
BLOCK_BYTES = 1 << 20
_U = np.uint64


def shingles(buf: np.ndarray, off: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle, repeats included, in row order."""
    low = LOWER[buf]
    start, end, row = words(low, off)
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(low), start, end)
    per_row = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(per_row) - per_row

    def run(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, _U)
        for k in range(n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + word[at + k])
        return h

    whole = np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    found, rows = [run(whole, size)], [row[whole]]
    for n in range(1, size):
        short = np.flatnonzero(per_row == n)
        found.append(run(first[short], n))
        rows.append(short)
    found, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return found[order], rows[order]


def sets(buf: np.ndarray, off: np.ndarray, level: np.ndarray | None = None):
    """Distinct shingles of every row in the global order, and the offsets of the rows."""
    h, row = shingles(buf, off)
    if level is None:
        order = np.lexsort((h, row))
    else:
        order = np.lexsort((h, level[h >> _U(64 - SKETCH_BITS)], row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(off)))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values)])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.minimum(n, np.where(n > 0, n - (n * percent + 99) // 100 + 1 + n // SHARE_STEP, 0))


def least_shared(n):
    """Prefix shingles that a set of n shingles shares with a set that is not smaller and meets the threshold."""
    return 1 + F.floor(n / SHARE_STEP)


def common_levels(docs: DataFrame) -> np.ndarray:
    """log2 of how often repeated shingles were seen, in 2**SKETCH_BITS cells."""

    @tidy
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            held.clear()
            h.sort()
            again = h[1:][h[1:] == h[:-1]]  # every repeated shingle, once less than it was seen
            first = np.ones(len(again), bool)
            first[1:] = again[1:] != again[:-1]
            total = sum(np.bincount((x >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                        for x in (again, again[first]))
            cell = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

        for _, buf, off in text_blocks(batches, "id", "text", BLOCK_BYTES):
            held.append(sets(buf, off)[0])
            n += len(held[-1])
            if n >= COUNTED:
                yield flush()
                n = 0
        if n:
            yield flush()

    cells = (docs.mapInArrow(repeated, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
             .select("cell", F.floor(F.log2("n")).cast("int").alias("level")).toPandas())
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    level[cells["cell"].to_numpy()] = cells["level"].to_numpy()
    return level


def signatures(docs: DataFrame, level) -> DataFrame:
    """(id, n, s1, s2: the set; p1, p2: the prefix) per row."""

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_blocks(batches, "id", "text", BLOCK_BYTES):
            h, at = sets(buf, off, level.value)
            n = np.diff(at)
            mixed = [mix(h ^ _U(salt)) for salt in (0x5BD1E995, 0x27D4EB2F)]
            inside = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(prefix_length(n), n)
            cols = [row_sums(m, at) for m in mixed] + [row_sums(np.where(inside, m, _U(0)), at) for m in mixed]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *map(pa.array, cols)],
                                             ["id", "n", "s1", "s2", "p1", "p2"])

    return docs.mapInArrow(sign, "id long, n long, s1 long, s2 long, p1 long, p2 long")


def prefix_tokens(docs: DataFrame, level, leaders: DataFrame) -> DataFrame:
    """(token, gid, pos): prefix shingles of the leaders (and of a few ids that the filter lets through), and their place."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(leaders.select(F.col("gid").alias("id"))))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_blocks(filtered(batches, bits.value), "id", "text", BLOCK_BYTES):
            h, at = sets(buf, off, level.value)
            n = np.diff(at)
            place = np.arange(len(h)) - np.repeat(at[:-1], n)
            inside = place < np.repeat(prefix_length(n), n)
            owner = np.repeat(ids.to_numpy(zero_copy_only=False), prefix_length(n))
            yield pa.RecordBatch.from_arrays([pa.array(h[inside].view(np.int64)), pa.array(owner, pa.int64()),
                                              pa.array(place[inside].astype(np.int32))], ["token", "gid", "pos"])

    return docs.withColumn("h", filter_place()).mapInArrow(cut, "token long, gid long, pos int")


def filter_place():
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS)


def filtered(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column("h").to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(((bits[h >> 6] >> (h & 63)) & 1).astype(bool)))


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bitmap of fixed size that holds every wanted id (and may hold others)."""
    words_ = (ids.select(filter_place().alias("h")).groupBy(F.shiftright("h", 6).alias("word"))
              .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words_["word"].to_numpy(dtype=np.int64)] = words_["bits"].to_numpy()
    return out


def parity_maps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MAP_WORDS words per row: bit b tells whether the row has an odd number of the shingles that fall on b."""
    bits = 64 * MAP_WORDS
    out = np.zeros((len(at) - 1, MAP_WORDS), np.int64)
    for i in range(0, len(out), 1024):
        ends = at[i:i + 1025]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        cell = ((h[ends[0]:ends[-1]] >> _U(16)) % _U(bits)).astype(np.int64)
        odd = np.bincount(row * bits + cell, minlength=(len(ends) - 1) * bits) & 1
        out[i:i + 1024] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, MAP_WORDS)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes, map) of the wanted ids, and a few others: 48-bit hashes of the whole set, packed, and its parity map."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_blocks(filtered(batches, bits.value), "id", "text", BLOCK_BYTES):
            found, at = sets(buf, off)
            low = np.ascontiguousarray(found >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            packed = low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([packed[6 * i:6 * j] for i, j in zip(at[:-1], at[1:])], pa.binary()),
                 pa.array(list(parity_maps(found, at)), pa.list_(pa.int64()))], ["id", "hashes", "map"])

    return materialize(docs.withColumn("h", filter_place())
                       .mapInArrow(collect, "id long, hashes binary, map array<long>"), "sets")


def differing():
    """The bits that differ in all pairs of sets of the places x and y."""
    def differ(a: str, b: str):
        sure = F.zip_with(f"{a}.all", f"{b}.any", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(sure, F.lit(0), lambda total, n: total + n)

    return differ("x", "y") + differ("y", "x")


def near(percent: int):
    """Whether sets of the places x and y may meet the threshold: the bits that differ in all their pairs are few enough."""
    return (100 + percent) * differing() <= (100 - percent) * (F.col("x.n") + F.col("y.n"))


def verified(pairs: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""

    def unpack(blob: bytes) -> np.ndarray:
        raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :6] = raw
        return out.view(np.uint64).ravel()

    @tidy
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = unpack(x.as_py()), unpack(y.as_py())
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = held.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = held.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long").distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    level = spark.sparkContext.broadcast(common_levels(docs))
    rows = materialize(signatures(docs, level), "signatures")

    def fits(n, m):
        return (100 * F.least(n, m) >= percent * F.greatest(n, m))

    # distinct sets, and the groups of sets that agree in size and prefix
    classes = rows.filter("n > 0").groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("id").alias("id"))
    group_of = classes.groupBy("n", "p1", "p2").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("members"))
    members = materialize(classes.join(group_of, ["n", "p1", "p2"])
                          .select("id", "gid", "members", "n"), "members")

    # lists of the groups that hold a prefix shingle; groups on too few lists link with nothing
    leaders = members.filter("id = gid").select("gid", "n")
    tokens = prefix_tokens(docs, level, leaders).repartition("token")
    twice = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1").select("token")
    listed = materialize(tokens.join(twice, "token").groupBy("token", "gid").agg(F.min("pos").alias("pos")), "listed")
    enough = (listed.groupBy("gid").agg(F.count(F.lit(1)).alias("lists")).join(leaders, "gid")
              .filter(F.col("lists") >= least_shared(F.col("n") * percent / 100)).select("gid", "n"))
    shared = materialize(listed.join(enough, "gid"), "shared")
    lists = (shared.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.min("gid").alias("leader"),
                                         F.min_by("n", "gid").alias("leader_n")).filter("length > 1"))
    stars = (shared.join(lists, "token").filter((F.col("gid") > F.col("leader")) & fits(F.col("n"), F.col("leader_n")))
             .groupBy("gid", "leader").agg(F.count(F.lit(1)).alias("lists")))
    stars = materialize(stars, "stars")
    wanted = materialize(members.join(enough.select("gid"), "gid", "left_semi").select("id")
                         .unionByName(members.filter("members > 1").select("id")).distinct(), "wanted")
    held = whole_sets(docs, wanted)

    # first round: every group against its main leader, every set against the leader of its group
    main = stars.groupBy("gid").agg(F.max_by("leader", F.struct("lists", -F.col("leader"))).alias("a"))
    inner = members.filter("id > gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    tested = materialize(main.select("a", F.col("gid").alias("b")).unionByName(inner).distinct(), "tested")
    links = materialize(verified(tested, held, percent), "links")
    labels = components(links)

    # second round: the other leaders, where they are still apart
    def label(column):
        return labels.select(F.col("id").alias(column), F.col("component").alias(f"{column}_component"))

    apart = (stars.join(label("gid"), "gid", "left").join(label("leader"), "leader", "left")
             .filter(F.coalesce("gid_component", "gid") != F.coalesce("leader_component", "leader"))
             .select(F.col("leader").alias("a"), F.col("gid").alias("b")).join(tested, ["a", "b"], "left_anti"))
    apart = materialize(apart, "apart")
    tested = tested.unionByName(apart)
    more = materialize(verified(apart, held, percent), "more")
    if not more.isEmpty():
        labels = joined(labels, more)

    # lists of the same groups are one, with the first of their shingles (the groups of a list are distinct)
    same = shared.groupBy("token").agg(F.bit_xor(F.xxhash64("gid")).alias("list"), F.count(F.lit(1)).alias("length"))
    once = (shared.join(same.filter("length > 1"), "token").groupBy("list", "gid").agg(F.min("pos").alias("pos"))
            .withColumnRenamed("list", "token"))
    once = materialize(once, "lists")

    def placed(labels):
        """The sets that are still wanted with their components; the places, groups in a component; and the split lists."""
        part = members.join(labels, "id", "left").select("id", "gid", "n", F.coalesce("component", "id").alias("component"))
        part = materialize(part.join(wanted, "id", "left_semi"), "parts")
        # the bits that all sets of a group and component have, and those that any has
        maps = part.join(held.select("id", "map"), "id").select(
            "gid", "n", "component", *[F.get("map", F.lit(k)).alias(f"m{k}") for k in range(MAP_WORDS)])
        maps = maps.groupBy("gid", "n", "component").agg(*[f(f"m{k}").alias(f"{f.__name__}{k}")
                                                           for f in (F.bit_and, F.bit_or) for k in range(MAP_WORDS)])
        words_of = [F.array(*[f"{f}{k}" for k in range(MAP_WORDS)]).alias(name) for f, name in (("bit_and", "all"), ("bit_or", "any"))]
        places = materialize(maps.select("gid", "n", "component", *words_of), "places")
        rows_on = once.join(places, "gid")
        split = (rows_on.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low <> high").select("token"))
        return part, places, materialize(rows_on.join(split, "token", "left_semi"), "split")

    def a_set_of(part):
        """A set of each place."""
        return part.groupBy("gid", "component").agg(F.min("id").alias("id"))

    # the first shingle that two sets share leaves room for the overlap that the threshold asks for
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    able = (fits(F.col("x.n"), F.col("y.n")) & ((100 + percent) * room >= percent * (F.col("x.n") + F.col("y.n"))))

    # third round: the groups of each list against a few pivots of their list, where they are still apart
    part, places, rows_on = placed(labels)
    pivots = rows_on.groupBy("token").agg(*[
        F.min_by(F.struct("gid", "n", "pos", "component", "all", "any"), F.xxhash64("token", "gid", "component", F.lit(k)))
        .alias(f"pivot{k}") for k in range(PIVOTS)])
    pivots = pivots.select("token", F.explode(F.array_distinct(F.array(*[f"pivot{k}" for k in range(PIVOTS)]))).alias("pivot"))
    x, y = rows_on.alias("x"), pivots.select("token", "pivot.*").alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
                 & able & near(percent))
    one = a_set_of(part)
    met = (met.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("gid", "component")]).distinct()
           .join(one.toDF("gid_x", "component_x", "ix"), ["gid_x", "component_x"])
           .join(one.toDF("gid_y", "component_y", "iy"), ["gid_y", "component_y"])
           .select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b")).distinct()
           .join(tested, ["a", "b"], "left_anti"))
    met = materialize(met, "met")
    tested = tested.unionByName(met)
    more = materialize(verified(met, held, percent), "pivoted")
    if not more.isEmpty():
        labels = joined(labels, more)
        part, places, rows_on = placed(labels)

    # the pairs of places on one list, or in one group, that are still apart
    x, y = rows_on.alias("x"), rows_on.alias("y")
    ends = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("gid", "component")]
    ends.append((differing() / (F.col("x.n") + F.col("y.n"))).alias("far"))
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component"))
                    & able & near(percent))
    x, y = places.alias("x"), places.alias("y")
    inside = x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("x.component") < F.col("y.component")) & near(percent))
    blocks = materialize(across.select(*ends).unionByName(inside.select(*ends)).distinct(), "blocks")

    # fourth round: of the pairs between two components, the one that seems closest
    one = a_set_of(part)
    sides = ["gid_x", "component_x", "gid_y", "component_y"]
    closest = (blocks.groupBy("component_x", "component_y").agg(F.min_by(F.struct("gid_x", "gid_y"), F.struct("far", "gid_x", "gid_y")).alias("at"))
               .select("at.gid_x", "component_x", "at.gid_y", "component_y")
               .join(one.toDF("gid_x", "component_x", "ix"), ["gid_x", "component_x"])
               .join(one.toDF("gid_y", "component_y", "iy"), ["gid_y", "component_y"])
               .select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b")).distinct()
               .join(tested, ["a", "b"], "left_anti"))
    closest = materialize(closest, "closest")
    tested = tested.unionByName(closest)
    more = materialize(verified(closest, held, percent), "bridges")
    if not more.isEmpty():
        labels = joined(labels, more)
        roots = [labels.select(F.col("id").alias(f"component_{s}"), F.col("component").alias(f"root_{s}")) for s in "xy"]
        blocks = (blocks.join(roots[0], "component_x", "left").join(roots[1], "component_y", "left")
                  .filter(F.coalesce("root_x", "component_x") != F.coalesce("root_y", "component_y")))

    # last: all pairs of sets that are still apart
    px = part.select(F.col("gid").alias("gid_x"), F.col("component").alias("component_x"), F.col("id").alias("ix"))
    py = part.select(F.col("gid").alias("gid_y"), F.col("component").alias("component_y"), F.col("id").alias("iy"))
    pairs = (blocks.select(*sides).join(px, ["gid_x", "component_x"]).join(py, ["gid_y", "component_y"])
             .select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b")).distinct()
             .join(tested, ["a", "b"], "left_anti"))
    rest = materialize(verified(pairs, held, percent), "rest")
    if not rest.isEmpty():
        labels = joined(labels, rest)

    found = classes.join(labels, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    return (rows.join(found, ["n", "s1", "s2"], "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * same >= 80 * (x.n + y.n - same)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS origin, doc_id AS place FROM sizes
  UNION SELECT origin, b FROM reach JOIN ways ON ways.a = reach.place),
labels AS (SELECT origin AS doc_id, min(place) AS component_id FROM reach GROUP BY origin)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM words d LEFT JOIN sizes USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
