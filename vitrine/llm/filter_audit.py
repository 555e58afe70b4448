"""Filter interaction audit by truth-table survival words.

Five filters A to E give 32 subsets.  A document becomes one 32-bit word: bit S is
set when the document passes every filter of subset S.  Words of a part and label
are counted bit by bit with carry-save adders (``positional_popcount``): the
result, survivors of each subset, answers every order of the filters, because what
an order keeps after k steps is what the subset of its first k letters keeps.

Filters (failure conditions) over whole texts; words are longest runs without
white space, case-sensitive:
A: under ``MIN_WORDS`` words; B: 100 * distinct words < ``DISTINCT`` * words;
C: 100 * capitals A-Z > ``CAPITALS`` * code points; D: holds one of ``SYMBOLS``;
E: identical to the text of any smaller id in the whole table.

Defined cases: a null text is empty (fails A; equal to other empty texts); a null
part is the empty string; a null id is neither smaller nor larger than another, so
it passes E and has no label; rows that repeat an id and its text pass or fail E
together; an id that several label rows name has a label when one of them says so;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Bit S of a filter's pattern says whether subset S holds it: the truth table's input columns.
PATTERNS = {name: sum(1 << s for s in range(32) if s >> k & 1) for k, name in enumerate(FILTERS)}
EVERY = (1 << 32) - 1
#: A group of equal texts is hot with this share of all rows, so at most 1 / share groups are.
HOT_SHARE = 0.001
#: Counters (part, label) that a task holds before it passes them on.
HELD = 4096
#: Labels: every document, those of good quality, toxic ones.
ALL, GOOD, TOXIC = 0, 1, 2


def survival_word(fails: dict[str, Column]) -> Column:
    """The 32-bit word, as a long, of the subsets that a document survives."""
    lost = F.lit(0).cast("long")
    for name, failed in fails.items():
        lost = lost.bitwiseOR(F.when(failed, F.lit(PATTERNS[name])).otherwise(F.lit(0)).cast("long"))
    return F.lit(EVERY).cast("long").bitwiseXOR(lost)


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text only."""
    listed = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n_words, n_distinct = F.size(listed), F.size(F.array_distinct(listed))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n_words < MIN_WORDS, "B": 100 * n_distinct.cast("long") < DISTINCT * n_words.cast("long"),
            "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"), "D": text.rlike(SYMBOLS)}


def survival_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, word) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                                   survival_word(text_failures(text)).alias("word"),
                                   F.unhex(F.sha2(text, 256)).alias("digest")), "verdicts")
    total = rows.count()
    copied = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                                    F.count(F.lit(1)).alias("n")).filter("last > first"), "copied")
    # at most 1 / HOT_SHARE texts hold HOT_SHARE of the rows each: a proven bound for a broadcast
    is_hot = F.col("n") >= max(2.0, HOT_SHARE * total)
    hot = F.broadcast(copied.filter(is_hot).select("digest", "first"))
    cold = copied.filter(~is_hot).select("digest", "first")
    without = F.lit(EVERY ^ PATTERNS["E"]).cast("long")
    repeated = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    word = F.when(repeated, F.col("word").bitwiseAND(without)).otherwise(F.col("word")).alias("word")
    return (rows.join(hot, "digest").select("id", "part", word)
            .unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left").select("id", "part", word)))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How often each of 32 bits is set.  Carry-save adders reduce three words of a weight to
    a sum of that weight and a carry of twice the weight, for all 32 places at once."""
    total, weight = np.zeros(32, np.int64), 1
    layer = words.astype(np.uint32, copy=False)
    places = np.arange(32, dtype=np.uint32)
    while len(layer):
        carries = []
        while len(layer) > 2:
            third = len(layer) // 3
            a, b, c = layer[:third], layer[third:2 * third], layer[2 * third:3 * third]
            half = a ^ b
            carries.append(a & b | half & c)
            layer = np.concatenate([half ^ c, layer[3 * third:]])
        total += weight * (layer[:, None] >> places & np.uint32(1)).sum(axis=0, dtype=np.int64)
        layer = np.concatenate(carries) if carries else layer[:0]
        weight *= 2
    return total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset per (part, label), added up within the task."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()),
             pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "label", "survivors"])

    for batch in batches:
        if not batch.num_rows:
            continue
        named = pc.dictionary_encode(batch.column("part"))
        names = named.dictionary.to_pylist()
        key = named.indices.to_numpy().astype(np.int64) * 3 + batch.column("label").to_numpy()
        order = np.argsort(key, kind="stable")
        word = batch.column("word").to_numpy().astype(np.uint32)[order]
        found, first = np.unique(key[order], return_index=True)
        for k, own in zip(found.tolist(), np.split(word, first[1:])):
            at = names[k // 3], k % 3
            count = positional_popcount(own)
            held[at] = held[at] + count if at in held else count
        if len(held) > HELD:
            yield out()
            held = {}
    if held:
        yield out()


def subset_survivors(words: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(part, all, good, toxic): for each label the survivors of subsets 0 to 31 as an array."""
    marked = (labels.groupBy(F.col(label_id).cast("long").alias("id"))
              .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                   F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")).filter("good or bad"))
    kinds = F.filter(F.array(F.when(F.col("good"), F.lit(GOOD)), F.when(F.col("bad"), F.lit(TOXIC))), lambda k: k.isNotNull())
    rows = words.select("part", F.lit(ALL).alias("label"), "word").unionByName(
        words.join(marked, "id").select("part", F.explode(kinds).alias("label"), "word"))
    partial = rows.mapInArrow(_counted, "part string, label int, survivors array<bigint>")
    sums = [F.sum(F.when(F.col("label") == k, F.col("survivors")[s]).otherwise(F.lit(0))).alias(f"s{k}_{s}")
            for k in (ALL, GOOD, TOXIC) for s in range(32)]
    wide = partial.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[F.col(f"s{k}_{s}") for s in range(32)]).alias(name)
                                 for k, name in ((ALL, "all"), (GOOD, "good"), (TOXIC, "toxic"))])


def shapley(k: int) -> Column:
    """What filter k removes, summed over all orders: a subset S of the others comes before it in |S|! (4 - |S|)! of them."""
    terms = [(factorial(bin(s).count("1")) * factorial(4 - bin(s).count("1")), s) for s in range(32) if not s >> k & 1]
    out = F.lit(0).cast("long")
    for ways, s in terms:
        out = out + F.lit(ways) * (F.col("all")[s] - F.col("all")[s | 1 << k])
    return out


def orders() -> list[dict]:
    """Every step of every order: its filter, and the subsets before and after it."""
    out = []
    for order in permutations(range(5)):
        before = 0
        for step, k in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "k": k,
                        "was": before, "now": before | 1 << k})
            before |= 1 << k
    return out


def interaction_audit(survivors: DataFrame) -> DataFrame:
    """One row per part, order and step, from the survivors of each subset."""
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, k int, was int, now int>>")
    one = survivors.select("part", "all", "good", "toxic", F.array(*[shapley(k) for k in range(5)]).alias("shares"),
                           F.explode(steps).alias("at"))
    at = {c: F.col(f"at.{c}") for c in ("k", "was", "now")}
    alone = F.array(*[F.lit(1 << k) for k in range(5)])
    others = F.array(*[F.lit(31 ^ 1 << k) for k in range(5)])
    lost = {name: F.col(name)[at["was"]] - F.col(name)[at["now"]] for name in ("all", "good", "toxic")}
    return one.select(
        "part", "at.filter_order", "at.step", F.col("all")[at["now"]].alias("kept"), lost["all"].alias("removed"),
        (F.col("all")[0] - F.col("all")[alone[at["k"]]] - lost["all"]).alias("redundant"),
        (F.col("all")[others[at["k"]]] - F.col("all")[31]).alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.col("shares")[at["k"]].alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(survival_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return interaction_audit(subset_survivors(words, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
judged AS (
  SELECT doc_id, part,
         (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT} * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t))::INT
         + 8 * regexp_matches(t, '{SYMBOLS}')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails
  FROM texts JOIN firsts USING (t)),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
groups AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(range(5)) AS k),
orders AS (
  SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT 'ABCDE'[a + 1] || 'ABCDE'[b + 1] || 'ABCDE'[c + 1] || 'ABCDE'[d + 1] || 'ABCDE'[e + 1] AS filter_order,
         step, [a, b, c, d, e][step] AS k, coalesce(list_sum([1 << x FOR x IN [a, b, c, d, e][:step - 1]]), 0)::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, k,
         coalesce(sum(n) FILTER (fails & (before | (1 << k)) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails & before <> 0 AND fails & (1 << k) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = (1 << k)), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0) AS good_lost,
         coalesce(sum(bad) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0) AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted
"""
