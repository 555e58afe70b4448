"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is a restaurant for the words that follow it; all share one parent,
the restaurant of single words, whose base is uniform.  Tables of a context are
customers of the parent.  The tables of every dish are drawn from the
distribution that Gibbs sampling of its customers ends in, given the tables of
their context and the parent's probability as the round before drew them; an
exchange between the rounds adds the tables up by context and by word and seats
the parent.  The predictive probability is the mean over the last ``SAMPLES``
rounds; ``BURN_IN`` rounds come before.

Counts are gathered from all training texts in exchanges between blocks of
texts and parts of the key space: a block sends its distinct words (or word
pairs) once with their counts, a part adds them up and answers every block in
the order of its keys.  A hot word or pair reaches its part once per block, and
parts are sized by the input, so no task grows with it.

1. Texts become blocks of word numbers, written once, bucketed by block.
2. Words: counts, vocabulary.  3. Pairs: counts; one block owns each pair, and
   the pairs that a block owns are written beside its texts.
4. In each round the owner of each pair draws its tables and reports them by
   context and by word.  A pair's random numbers follow from its key and the
   round, so every block draws the same seating when it scores.
5. Scores.

All dishes of a round are drawn at once, given the round before (a synchronous
Gibbs sampler).  The first round has none before it: its weights take the tables
from the power law of the process (counts to the power ``GROWTH``).  Words are told
apart by 56-bit hashes, pairs by 48-bit hashes.  The draw is exact up to
``EXACT`` customers of a dish; beyond, it has the saddle point's mean and variance.

Defined cases: null and empty texts are one end token; null ids train and are
scored; rows that repeat an id are separate texts; without training texts every
known count is 0 and scores use the base; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.textops import LOWER, blocks as text_ranges, crc_mod5, mix, prefix_hash, span_hash, text_blocks, words
from vitrine.llm.workers import give_back, tidy
from vitrine.operators.lineage import materialize

KEY_BITS, PAIR_BITS = 56, 48
#: Concentrations of both levels; discounts are estimated from the counts of counts.
STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 4
#: Customers of a dish up to which the distribution of their tables is exact.
EXACT = 256
#: Customers of a dish from which on tables of no weight are left out, and how far below the top (a logarithm) weights
#: are less than the rounding of a sum.
FEW, NOTHING = 12, 40.0
#: Weights that are worked out together: they stay in a core's cache.
AT_ONCE = 1 << 14
#: Tables grow as customers to this power, in the weights of the first round only.
GROWTH = 0.75
#: Text of a block, and of a part of the key space.
BLOCK_BYTES, PART_BYTES = 1 << 22, 1 << 25
#: Text whose words are hashed at once.
HASHED_BYTES = 1 << 18
#: Keys of a text's start and end.
START, END = 1, 2
_U = np.uint64


def squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small differences leave empty planes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def spread(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_keys(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every word.  Few texts are hashed at a time: the sums take many times the text, a key is the same."""
    keys, rows = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for i, j in text_ranges(off, HASHED_BYTES):
        start, end, row = words(low[off[i]:off[j]], off[i:j + 1] - off[i])
        if len(start):
            keys.append(span_hash(prefix_hash(low[off[i]:off[j]]), start, end) >> _U(64 - KEY_BITS))
            rows.append(row + i)
    return np.concatenate(keys), np.concatenate(rows)


def token_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, lengths, training, keys, tokens): word numbers of the texts of a block."""

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_blocks(batches, "id", "text", BLOCK_BYTES):
            key, row = word_keys(LOWER[buf], off)
            n = np.bincount(row, minlength=len(off) - 1) + 1  # and one end
            stream = np.full(int(n.sum()), END, _U)
            stream[np.arange(len(key)) + row] = key
            keys, tokens = np.unique(np.concatenate([[_U(START)], [_U(END)], stream]), return_inverse=True)
            names = ids.to_pylist()
            training = np.array([crc_mod5("" if i is None else i) != 1 for i in names], bool)
            null = np.array([i is None for i in names], bool)
            plain = np.array([0 if i is None else i for i in names], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), *[pa.array([squeeze(x)], pa.binary()) for x in (
                    plain, null, n.astype(np.int64), training, np.diff(keys, prepend=_U(0)), tokens[2:].astype(np.int32))]],
                ["block", "ids", "no_id", "lengths", "training", "keys", "tokens"])

    return docs.mapInArrow(encode, "block long, ids binary, no_id binary, lengths binary, training binary, "
                                   "keys binary, tokens binary")


def pair_keys(keys: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(keys[context]) + keys[word] * _U(0x9E3779B97F4A7C15)) >> _U(64 - PAIR_BITS)


def entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one: each is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Block:
    """A block's words, word pairs and the place of each token among them."""

    def __init__(self, row: dict):
        self.name, self.row = row["block"], row
        self.lengths = spread(row["lengths"], np.int64)
        self.training = spread(row["training"], bool)
        self.keys = np.cumsum(spread(row["keys"], _U), dtype=_U)
        self.tokens = spread(row["tokens"], np.int32)
        self.in_training = np.repeat(self.training, self.lengths)
        self.start = int(np.searchsorted(self.keys, _U(START)))
        self.end = int(np.searchsorted(self.keys, _U(END)))

    def pairs(self, of_tokens: bool = True) -> None:
        """Distinct (context, word) in key order, and the pair of every token unless that is not asked for."""
        first = np.cumsum(self.lengths) - self.lengths
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[first] = self.start
        both = context.astype(np.int64) * len(self.keys) + self.tokens
        local, of_token = np.unique(both, return_inverse=True) if of_tokens else (np.unique(both), None)
        context, word = local // len(self.keys), local % len(self.keys)
        key = pair_keys(self.keys, context, word)
        order = np.argsort(key)
        self.context, self.word, self.pair_keys = context[order], word[order], key[order]
        if of_tokens:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.pair_of = place[of_token]

    def training_counts(self, of_token: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(of_token[self.in_training], minlength=size).astype(np.int64)


def report_rows(block: int, keys: np.ndarray, values: list[np.ndarray], drop: int) -> pa.RecordBatch:
    """Sorted keys and their values, a row for each part: the keys without their last ``drop`` bits."""
    part = (keys >> _U(drop)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    rows = list(zip(cut[:-1], cut[1:]))
    cols = [pa.array([int(part[i]) for i, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
            pa.array([squeeze(np.diff(keys[i:j], prepend=_U(0))) for i, j in rows], pa.binary())]
    cols += [pa.array([squeeze(v[i:j]) for i, j in rows], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays(cols, ["part", "block", "keys", *[f"v{k}" for k in range(len(values))]])


def exchange(reports: DataFrame, combine: Callable, kinds: list, answers: list, stats: int) -> DataFrame:
    """(block, part, a0.., s0..): what each part answers to each block, in the order of its keys.

    ``combine(which, inverse, size, values)`` gets the distinct key of every entry and returns answers per
    distinct key or entry, and numbers that are added up over all parts."""

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(spread(x.as_py(), _U), dtype=_U) for x in table.column("keys")]
        at = np.cumsum([0] + [len(x) for x in lists])
        keys, first, inverse = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        values = [np.concatenate([spread(x.as_py(), kind) for x in table.column(f"v{k}")]) for k, kind in enumerate(kinds)]
        result, numbers = combine(keys, first, inverse, values)
        del keys, first, inverse, values
        out = {"block": table.column("block"), "part": table.column("part")}
        for k, a in enumerate(result):
            out[f"a{k}"] = pa.array([squeeze(a[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())
        for k, n in enumerate(numbers):
            out[f"s{k}"] = pa.array([float(n)] + [0.0] * (len(lists) - 1))
        del lists, result
        give_back()
        return pa.table(out)

    schema = "block long, part long" + "".join(f", a{k} binary" for k in range(len(answers)))
    schema += "".join(f", s{k} double" for k in range(stats))
    return materialize(reports.groupBy("part").applyInArrow(meet, schema), "answers")


def totals(answers: DataFrame, stats: int) -> list[float]:
    return [x or 0.0 for x in answers.agg(*[F.sum(f"s{k}") for k in range(stats)]).first()]


def gathered(answers: DataFrame, name: str, count: int) -> DataFrame:
    """(block, name): each block's answers in the order of the parts."""
    fields = F.struct("part", *[f"a{k}" for k in range(count)])
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(fields)).alias(name))


def kept(df: DataFrame, buckets: int) -> DataFrame:
    """Rows written once, bucketed by block: every round reads them, none shuffles them again."""
    table = f"by_block_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "block").saveAsTable(table)
    return df.sparkSession.table(table)


def read(parts: list[dict], k: int, kind) -> np.ndarray:
    return np.concatenate([spread(p[f"a{k}"], kind) for p in parts])


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2.0 * twice))) if once else 0.5


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + _U((step * 0xD1342543DE82EF95) % (1 << 64))) >> _U(11)).astype(np.float64) * 2.0 ** -53


@lru_cache(8)
def arrangements(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weight of n customers at t tables, for n up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        out[n + 1, 1:n + 1] = np.log(n - d * t) + out[n, 1:n + 1]
        out[n + 1, 1:n + 2] = np.logaddexp(out[n + 1, 1:n + 2], out[n, :n + 1])
    return out


def many_tables(n: np.ndarray, fresh: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Saddle-point mean and variance of the tables beyond the first of n > EXACT customers."""
    ratio = np.log(n) - np.log(fresh)
    low = np.minimum(np.log(0.5), -(ratio + np.log(2.0)) / (1 - d))
    high = np.minimum(0.0, -ratio / (1 - d))
    for _ in range(60):  # (1 - y) y ** (d - 1) = n / fresh, in the logarithm of y
        y = (low + high) / 2
        above = np.log(-np.expm1(np.minimum(y, -1e-300))) + (d - 1) * y > ratio
        low, high = np.where(above, y, low), np.where(above, high, y)
    y = np.exp((low + high) / 2)
    x = -np.expm1((low + high) / 2)
    whole = fresh * -np.expm1(d * (low + high) / 2) / d
    mean = whole - 1 + (1 - d) * x / (y + (1 - d) * x)
    return np.clip(mean, 1e-12, n - 1), np.clip(whole - n * y / (y + (1 - d) * x), 1e-12, None)


def seating(count: np.ndarray, fresh: np.ndarray, key: np.ndarray, d: float, draw: int = 0) -> np.ndarray:
    """A draw of the number of tables of ``count`` customers with one dish; ``fresh``: weight of a new table.

    The distribution is the one that Gibbs sampling of the customers ends in: fresh ** t times the weight of all
    arrangements at t tables; exact up to EXACT customers, beyond with the mean and variance of the saddle point."""
    tables = (count > 0).astype(np.float64)
    weight = np.log(fresh)
    small = np.flatnonzero((count > 1) & (count <= EXACT))
    small = small[np.argsort(count[small].astype(np.uint16), kind="stable")]
    chance = uniform(key[small], 2 * draw + 1)
    ends = np.flatnonzero(np.diff(count[small], append=EXACT + 1)) + 1
    for begin, end in zip([0, *ends[:-1]], ends):
        c = int(count[small[begin]])
        t, ways = np.arange(1, c + 1)[:, None], arrangements(d)[c, 1:c + 1][:, None]
        same = begin + np.argsort(weight[small[begin:end]]) if c > FEW else np.arange(begin, end)
        step = max(64, AT_ONCE // c)
        for k in range(0, len(same), step):
            at = same[k:k + step]
            these, last = small[at], c
            if c > FEW:  # the heaviest: weights fall on both sides of their top, what is left out changes no sum
                p = weight[these[-1]] * t + ways
                last = np.flatnonzero(p >= p.max() - NOTHING)[-1] + 1
            p = weight[these] * t[:last] + ways[:last]  # a row per number of tables
            p = np.cumsum(np.exp(p - p.max(axis=0)), axis=0)
            tables[these] = np.minimum(1 + np.count_nonzero(p <= chance[at] * p[-1], axis=0), c)
    large = np.flatnonzero(count > EXACT)
    if len(large):
        n = count[large].astype(np.float64)
        mean, variance = many_tables(n, fresh[large], d)
        u, v = uniform(key[large], 2 * draw + 1), uniform(key[large], 2 * draw + 2)
        more = np.rint(mean + np.sqrt(variance) * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v))
        few = np.flatnonzero(mean < 50)  # binomial of the same mean and variance, by its cumulated probabilities
        m, q = mean[few], np.clip(1 - variance[few] / mean[few], 1e-9, 0.999)
        p = np.exp(m * np.log1p(-q) / q)
        total, found = p.copy(), np.zeros(len(few))
        for k in range(200):
            open_ = total <= u[few]
            if not open_.any():
                break
            found += open_
            p = p * np.maximum(m - k * q, 0.0) / ((k + 1) * (1 - q))
            total += p
        more[few] = found
        tables[large] = np.clip(1 + more, 1, n)
    return tables


class Model:
    """Numbers of the whole corpus that a block needs besides its own words and pairs."""

    def __init__(self, tokens: float, vocabulary: float):
        self.tokens, self.vocabulary = tokens, vocabulary
        self.base = 1.0 / (vocabulary + 1.0)
        self.d = self.d0 = 0.5
        self.power = self.customers = self.tables = 0.0

    def fresh(self, followed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sampler's weight of a new table for words of ``counts`` after contexts of ``followed`` customers."""
        return (STRENGTH + self.d * followed ** GROWTH) * (counts + 0.5) ** GROWTH / max(self.power, 1.0)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the parent restaurant."""
        back = (STRENGTH + self.d0 * self.tables) * self.base
        return (np.maximum(customers - self.d0 * tables, 0.0) + back) / (STRENGTH + self.customers)


def language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    bits = max(1, (wanted - 1).bit_length())
    buckets = min(1024, 1 << bits)
    blocks = kept(token_blocks(docs), buckets)

    @tidy
    def count_words(batches):
        for r in entry_rows(batches):
            b = Block(r)
            yield report_rows(b.name, b.keys, [b.training_counts(b.tokens, len(b.keys))], KEY_BITS - bits)

    def add_words(keys, first, inverse, values):
        total = np.bincount(inverse, values[0], len(keys)).astype(np.int64)
        return [total[inverse]], [total.sum(), (total > 0).sum(), (total.astype(np.float64) ** GROWTH).sum()]

    report = "part long, block long, keys binary, v0 binary"
    counted = exchange(blocks.mapInArrow(count_words, report), add_words, [np.int64], [np.int64], 3)
    tokens, vocabulary, power = totals(counted, 3)
    model = Model(tokens, vocabulary)
    model.power = power
    word_counts = kept(gathered(counted, "words", 1), buckets)

    @tidy
    def count_pairs(batches):
        for r in entry_rows(batches):
            b = Block(r)
            b.pairs()
            yield report_rows(b.name, b.pair_keys, [b.training_counts(b.pair_of, len(b.pair_keys))], PAIR_BITS - bits)

    def add_pairs(keys, first, inverse, values):
        total = np.bincount(inverse, values[0], len(keys)).astype(np.int64)
        own = np.zeros(len(inverse), bool)
        own[first] = True
        return [total[inverse], own], [(total == 1).sum(), (total == 2).sum()]

    paired = exchange(blocks.mapInArrow(count_pairs, report), add_pairs, [np.int64], [np.int64, bool], 2)
    model.d = discount(*totals(paired, 2))
    pair_counts = kept(gathered(paired, "pairs", 2), buckets)
    state = blocks.join(word_counts, "block").join(pair_counts, "block")

    @tidy
    def own_pairs(batches):
        """The training pairs that a block owns, by the places of their words among its keys: no round sorts tokens."""
        for r in entry_rows(batches):
            b = Block(r)
            b.pairs(of_tokens=False)
            counts, mine = read(r["pairs"], 0, np.int64), read(r["pairs"], 1, bool)
            mine &= counts > 0
            place = b.context[mine] * len(b.keys) + b.word[mine]
            order = np.argsort(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.name], pa.int64()), pa.array([squeeze(np.diff(place[order], prepend=0))], pa.binary()),
                 pa.array([squeeze(counts[mine][order])], pa.binary())], ["block", "places", "counts"])

    owned = kept(blocks.join(pair_counts, "block").mapInArrow(own_pairs, "block long, places binary, counts binary"), buckets)
    owned = blocks.select("block", "keys").join(owned, "block")

    def context_counts(keys, counts):
        """Customers of each context: a word is followed as often as it occurs, the start once per text."""
        start, end = np.searchsorted(keys, [_U(START), _U(END)])
        out = counts.astype(np.float64)
        out[start] = out[end]
        out[end] = 0.0
        return out

    def seats(r, k):
        """Customers of each context, customers and tables of each word after round ``k``."""
        return [read(r[f"round{k}"], i, np.int64) for i in range(3)]

    def drawn(keys, context, word, pairs, r, k, before, last=None):
        """The tables of pairs in round ``k``, given the round before; one customer has one table without a draw."""
        many = np.flatnonzero(pairs > 1)
        context, word = context[many], word[many]
        if k == 0:
            counts = read(r["words"], 0, np.int64)
            fresh = before.fresh(context_counts(keys, counts)[context], counts[word].astype(np.float64))
        else:
            held, customers, tables = last or seats(r, k - 1)
            fresh = (STRENGTH + before.d * held[context]) * before.parent(customers, tables)[word]
        out = (pairs > 0).astype(np.float64)
        out[many] = seating(pairs[many], fresh, pair_keys(keys, context, word), before.d, k)
        return out

    def report_tables(k, before):
        @tidy
        def send(batches):
            for r in entry_rows(batches):
                keys = np.cumsum(spread(r["keys"], _U), dtype=_U)
                place = np.cumsum(spread(r["places"], np.int64))
                context, word = place // len(keys), place % len(keys)
                t = drawn(keys, context, word, spread(r["counts"], np.int64), r, k, before)
                sums = [np.rint(np.bincount(of, t, len(keys))).astype(np.int64) for of in (context, word)]
                yield report_rows(r["block"], keys, sums, KEY_BITS - bits)
        return send

    def add_tables(k, before):
        def add(keys, first, inverse, values):
            held, customers = (np.rint(np.bincount(inverse, v, len(keys))).astype(np.int64) for v in values)
            weight = (STRENGTH + before.d0 * (before.tables if k else before.power)) * before.base
            tables = seating(customers, np.full(len(keys), weight), keys, before.d0, k).astype(np.int64)
            return ([v[inverse] for v in (held, customers, tables)],
                    [customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()])
        return add

    models, rounds = [model], []
    for k in range(BURN_IN + SAMPLES):
        last = owned.join(rounds[-1] if rounds else word_counts, "block")  # a round reads the one before only
        sent = last.mapInArrow(report_tables(k, models[k]), report + ", v1 binary")
        seated = exchange(sent, add_tables(k, models[k]), [np.int64] * 2, [np.int64] * 3, 4)
        after = Model(model.tokens, model.vocabulary)
        after.d = model.d
        after.customers, after.tables, once, twice = totals(seated, 4)
        after.d0 = discount(once, twice)
        models.append(after)
        rounds.append(kept(gathered(seated, f"round{k}", 3), buckets))
    for answers in rounds[BURN_IN - 1:]:
        state = state.join(answers, "block")

    @tidy
    def score(batches):
        for r in entry_rows(batches):
            b = Block(r)
            b.pairs()
            counts = read(r["words"], 0, np.int64)
            followed = context_counts(b.keys, counts)[b.context]
            pair = read(r["pairs"], 0, np.int64)
            p, last = 0.0, seats(r, BURN_IN - 1)
            for k in range(BURN_IN, BURN_IN + SAMPLES):
                t = drawn(b.keys, b.context, b.word, pair, r, k, models[k], last)
                held, customers, tables = last = seats(r, k)
                below = (STRENGTH + model.d * held[b.context]) * models[k + 1].parent(customers, tables)[b.word]
                p += (np.maximum(pair - model.d * t, 0.0) + below) / (STRENGTH + followed) / SAMPLES
            first = np.cumsum(b.lengths) - b.lengths
            alone = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            ids = pa.array(spread(r["ids"], np.int64), mask=spread(r["no_id"], bool))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(~b.training), pa.array(b.lengths),
                 pa.array(np.add.reduceat((counts > 0)[b.tokens].astype(np.int64), first)),
                 pa.array(np.full(len(first), int(model.tokens))),
                 pa.array(np.add.reduceat(alone[b.tokens], first)),
                 pa.array(np.add.reduceat(np.log10(p)[b.pair_of], first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return state.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                   "base_score double, score double")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
