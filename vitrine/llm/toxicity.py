"""Toxicity by a subsequence string-kernel support vector machine.

Kernel: all common subsequences of three characters of two words, each weighted
by decay ** span, normalised -- gaps and inserted characters lower a match, they
do not end it.  Training words come from labelled texts; Nystrom landmarks span
the feature space, and a weighted hinge loss is fitted in it.  The fitted
function is linear in subsequence weights, so it folds into one table over
character triples (its size depends on the alphabet only) and scoring a word
needs no landmark any more; the values are the same.  A second support vector
machine judges whole labelled texts: by the values of all their words (how many
and what share lie above each of ``LEVELS``, the mean, the strongest), so weak
words add up.  Its margin is calibrated on the labelled sample.

Letters beyond ASCII are told apart by their code point, in lower case; triples
with such a letter share ``WIDE`` cells by a hash.

Fitting uses at most ``SAMPLE_DOCS`` labelled texts and, besides the words added
in ``HARD_ROUNDS``, 3/2 of ``TRAIN_WORDS`` words: documented bounds of the
classifier.  Scoring reads every word of every text.

Defined cases: null and empty texts have no words and get the calibrated score
of an unmarked text; labels that are null, or that contradict each other for an
id, count as not toxic unless one says 1; without any labelled text of one of
the classes every score is the base rate (0 without labels); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.textops import crc_mod5, mix, powers, ragged, span_hash, text_blocks, words
from vitrine.llm.workers import tidy
from vitrine.operators.lineage import materialize

#: Labelled texts and words that the classifier is fitted on, and landmarks.
SAMPLE_DOCS, TRAIN_WORDS, LANDMARKS = 20000, 4000, 800
DECAY = 0.6
#: Times that look-alikes from other texts (a quarter of TRAIN_WORDS each) are added and the fit repeated.
HARD_ROUNDS = 2
#: Rows of features that fitting handles at a time.
BLOCK = 1024
#: Bytes of text that a worker scores at a time.
TEXT = 1 << 20
#: Subsequences of words that are weighed at a time; a worker's memory follows from it.
SUBSEQUENCES = 500_000
#: Pieces that a worker remembers with their values.
KNOWN = 2_000_000
#: A longer word is read as overlapping pieces of this length.
PIECE = 24

#: Word parts (five characters, the word's start is one) that toxic texts favour; words with one train the classifier.
PART, PARTS = 5, 200
#: A text's words are counted above each of these values.
LEVELS = np.arange(-9, 9) / 10

# characters: word edge 0, a-z 1..26, digits 27, other ASCII 28, and code points beyond ASCII themselves
_CLASS = np.arange(0x110000, dtype=np.int32)
_CLASS[:128] = 28
_CLASS[48:58] = 27
_CLASS[97:123] = np.arange(1, 27, dtype=np.int32)
ALPHABET = 30
WIDE = 1 << 16
CELLS = ALPHABET ** 3 + WIDE
_FOLD = np.arange(0x110000, dtype=np.int32)  # lower case of every code point that has one of its own
for _c in range(0x1F000):
    _low = chr(_c).lower()
    if len(_low) == 1:
        _FOLD[_c] = ord(_low)
_U = np.uint64

_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_WEIGHT = DECAY ** np.arange(32.0)


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of every subsequence of three in a word of a length, and its span (under 32)."""
    if length not in _triples:
        at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
        _triples[length] = at, (at[:, 2] - at[:, 0] + 1).astype(np.int32)
    return _triples[length]


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and weight of each subsequence for words of one length, each word's weights of norm one."""
    codes = np.pad(codes, ((0, 0), (1, 1)))  # both edges of the word are characters too
    at, span = triples(codes.shape[1])
    a, b, c = (codes[:, at[:, k]] for k in range(3))
    cell = (a * ALPHABET + b) * ALPHABET + c
    wide = np.flatnonzero((codes >= ALPHABET).any(axis=1))
    if len(wide):
        a, b, c = a[wide].astype(np.int64), b[wide].astype(np.int64), c[wide].astype(np.int64)
        hashed = mix(((a << 42) | (b << 21) | c).view(_U)) % _U(WIDE)
        beyond = (a >= ALPHABET) | (b >= ALPHABET) | (c >= ALPHABET)
        cell[wide] = np.where(beyond, ALPHABET ** 3 + hashed.astype(np.int64), cell[wide])
    cell = np.sort(cell << 5 | span, axis=1)  # a cell and its span in one number
    value = _WEIGHT[cell & 31]
    cell = cell >> 5
    last = np.ones(cell.shape, bool)  # equal subsequences add up in their last place
    last[:, :-1] = cell[:, 1:] != cell[:, :-1]
    total = np.cumsum(value, axis=1)
    total[~last] = 0.0
    before = np.maximum.accumulate(total, axis=1)
    value = total.copy()
    value[:, 1:] -= np.where(last[:, 1:], before[:, :-1], 0.0)
    norm = np.sqrt((value ** 2).sum(axis=1, keepdims=True))
    return cell, value / np.where(norm > 0, norm, 1.0)


def word_pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Pieces of at most PIECE bytes: (word, start, end); half of a piece overlaps the next."""
    word = np.arange(len(start))
    long = end - start > PIECE
    if not long.any():
        return word, start, end
    out = [(word[~long], start[~long], end[~long])]
    for w in np.flatnonzero(long):
        at = np.append(np.arange(start[w], end[w] - PIECE, PIECE // 2), end[w] - PIECE)
        out.append((np.full(len(at), w), at, at + PIECE))
    return tuple(np.concatenate(c) for c in zip(*out))


def letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 texts, and the offsets of the texts in them."""
    if not (buf > 127).any():
        return _FOLD[buf], off
    first = (buf & 0xC0) != 0x80
    at = np.flatnonzero(first)
    code = buf[at].astype(np.int32)
    size = 1 + (code >= 0xC0) + (code >= 0xE0) + (code >= 0xF0)
    code = np.where(size > 1, code & (0x7F >> size), code)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << 6 | (buf[np.minimum(at[more] + k, len(buf) - 1)] & 0x3F)
    return _FOLD[np.minimum(code, 0x10FFFF)], np.concatenate([[0], np.cumsum(first)])[off]


def narrow(low: np.ndarray) -> np.ndarray:
    """A byte for each code point, for what looks at ASCII only."""
    return np.minimum(low, 128).astype(np.uint8)


def spelled(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in which runs of single letters ("i d i o t") are one word."""
    start, end, row = words(narrow(low), off)
    one = (end - start == 1) & ((_CLASS[low[start]] < 27) | (low[start] > 191) & (low[start] < 0x250))
    joined = one[1:] & one[:-1] & (row[1:] == row[:-1]) & (start[1:] == end[:-1] + 1)
    if not joined.any():
        return low, off
    keep = np.ones(len(low), bool)
    keep[end[:-1][joined]] = False
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def letter_hash(low: np.ndarray) -> np.ndarray:
    """``textops.prefix_hash`` of code points."""
    out = np.zeros(len(low) + 1, _U)
    np.cumsum((mix(low.astype(_U) + _U(1)) | _U(1)) * powers(len(low) + 1)[0][:-1], out=out[1:])
    return out


@dataclass
class SubsequenceSvm:
    """Fitted function: a weight for each character triple, weights of a text's pooled words, and the calibration."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    #: Weights of ``pooled`` and a constant.
    pool: np.ndarray | None = None
    #: Hashes and values of the pieces that a worker has scored last, at most KNOWN.
    known: tuple[np.ndarray, np.ndarray] | None = None

    def words(self, codes: np.ndarray) -> np.ndarray:
        cell, value = features(codes)
        return (self.table[cell] * value).sum(axis=1) + self.bias

    def values(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of every word; a word's value is that of its strongest piece."""
        low, off = spelled(*letters(buf, off))
        start, end, row = words(narrow(low), off)
        if not len(start):
            return row, np.zeros(0)
        word, at, stop = word_pieces(low, start, end)
        name, first, back = np.unique(span_hash(letter_hash(low), at, stop), return_index=True, return_inverse=True)
        value = self.pieces(_CLASS[low], name, at[first], (stop - at)[first])[back]
        if len(word) == len(start):
            return row, value
        out = np.full(len(start), -np.inf)
        np.maximum.at(out, word, value)
        return row, out

    def strongest(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The strongest word of every text; -inf without words."""
        out = np.full(len(off) - 1, -np.inf)
        np.maximum.at(out, *self.values(buf, off))
        return out

    def pooled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row for every text: all its words' values by count and share above each level, mean and maximum."""
        rows = len(off) - 1
        row, value = self.values(buf, off)
        value = np.clip(value, -2.0, 2.0)
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        top = np.full(rows, -2.0)
        np.maximum.at(top, row, value)
        above = np.stack([np.bincount(row[value > t], minlength=rows) for t in LEVELS], 1)
        mean = (np.bincount(row, value + 1.0, minlength=rows) / n)[:, None]
        return np.hstack([np.log1p(above), np.sqrt(above / n[:, None]), mean, top[:, None]])

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Value of every text."""
        if self.pool is None:
            return self.strongest(buf, off)
        return self.pooled(buf, off) @ self.pool[:-1] + self.pool[-1]

    def pieces(self, code: np.ndarray, name: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Value of each piece (hash, start, length); pieces scored before are looked up."""
        value = np.full(len(at), self.bias)
        names, values = self.known or (np.zeros(0, name.dtype), np.zeros(0))
        place = np.searchsorted(names, name)
        seen = np.zeros(len(name), bool)
        inside = place < len(names)
        seen[inside] = names[place[inside]] == name[inside]
        value[seen] = values[place[seen]]
        for n in range(1, PIECE + 1):
            these = np.flatnonzero((length == n) & ~seen)
            step = max(1, SUBSEQUENCES // max(1, len(triples(n + 2)[1])))
            for k in range(0, len(these), step):
                part = these[k:k + step]
                value[part] = self.words(code[at[part][:, None] + np.arange(n)])
        if len(names) + len(name) > KNOWN:
            self.known = (name, value)
        else:
            place = place[~seen]
            self.known = (np.insert(names, place, name[~seen]), np.insert(values, place, value[~seen]))
        return value

    def probability(self, margin: np.ndarray) -> np.ndarray:
        z = self.slope * np.maximum(margin, -2.0) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def vector(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights of one word (used in fitting only)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    low, _ = letters(raw, np.array([0, len(raw)]))
    cell, value = features(_CLASS[low[:PIECE]][None, :])
    some = value[0] > 0  # a repeated subsequence has its weight in one place
    return cell[0][some], value[0][some]


def squared_hinge(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, lam: float, rounds: int = 60) -> np.ndarray:
    """Weights and constant by Newton steps on the active set: deterministic, a few small solves.

    ``pos`` and ``neg`` weigh each row as a toxic and as another example.  The normal equations
    are summed block by block, so nothing of the size of ``x`` is copied."""
    beta = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        normal, right = lam * np.eye(len(beta)), np.zeros(len(beta))
        normal[-1, -1] = 1e-9
        for k in range(0, len(x), BLOCK):
            block = np.hstack([x[k:k + BLOCK], np.ones((len(x[k:k + BLOCK]), 1))])
            margin = block @ beta
            up = np.where(margin < 1, pos[k:k + BLOCK], 0.0)
            down = np.where(margin > -1, neg[k:k + BLOCK], 0.0)
            normal += (block * (up + down)[:, None]).T @ block
            right += block.T @ (up - down)
        new = np.linalg.solve(normal, right)
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = new
    return beta


class Landmarks:
    """Sparse features of the landmark words, in order of cells, for kernel rows against all of them."""

    def __init__(self, marks: list[str]):
        rows = [vector(w) for w in marks]
        cell = np.concatenate([c for c, _ in rows])
        order = np.argsort(cell, kind="stable")
        self.size = len(marks)
        self.cell = cell[order]
        self.mark = np.repeat(np.arange(len(marks), dtype=np.int32), [len(c) for c, _ in rows])[order]
        self.value = np.concatenate([v for _, v in rows])[order]

    def kernel(self, word: str) -> np.ndarray:
        """Kernel values of a word and every landmark."""
        cell, value = vector(word)
        first = np.searchsorted(self.cell, cell)
        many = np.searchsorted(self.cell, cell, side="right") - first
        at = ragged(first, many)
        return np.bincount(self.mark[at], self.value[at] * np.repeat(value, many), minlength=self.size)

    def table(self, weight: np.ndarray) -> np.ndarray:
        """The function with these landmark weights, as one weight per cell."""
        return np.bincount(self.cell, self.value * weight[self.mark], minlength=CELLS)


def fit_words(train: list[tuple[str, float, float]], landmarks: int = LANDMARKS, cost: float = 1.0) -> SubsequenceSvm:
    """Weighted hinge loss over words (word, weight toxic, weight other) in the Nystrom space."""
    train = sorted(train, key=lambda t: (-(t[1] + 1) / (t[2] + 1), t[0]))
    m = min(landmarks, len(train))
    # half of the landmarks from the words that toxic texts favour, half spread over all others
    head = train[:m // 2]
    rest = train[m // 2:]
    marks = [t[0] for t in head + rest[::max(1, len(rest) // max(1, m - len(head)))][:m - len(head)]]
    base = Landmarks(marks)
    value, axes = np.linalg.eigh(np.stack([base.kernel(w) for w in marks]))
    good = value > 1e-6 * max(value[-1], 1e-12)
    whiten = axes[:, good] / np.sqrt(value[good])
    x = np.empty((len(train), whiten.shape[1]))  # Nystrom features
    for k in range(0, len(train), BLOCK):
        x[k:k + BLOCK] = np.stack([base.kernel(t[0]) for t in train[k:k + BLOCK]]) @ whiten
    weight = np.sqrt(np.array([t[1:] for t in train], float).reshape(-1, 2))
    weight /= weight.sum()
    beta = squared_hinge(x, weight[:, 0], weight[:, 1], 1e-5 / cost)
    return SubsequenceSvm(base.table(whiten @ beta[:-1]), float(beta[-1]))


def fit_texts(model: SubsequenceSvm, pooled: np.ndarray, label: np.ndarray) -> None:
    """Hinge loss over the pooled words of labelled texts."""
    middle, scale = pooled.mean(axis=0), np.maximum(pooled.std(axis=0), 1e-3)
    beta = squared_hinge((pooled - middle) / scale, label / len(label), (1.0 - label) / len(label), 1e-4)
    model.pool = np.append(beta[:-1] / scale, beta[-1] - (beta[:-1] / scale) @ middle)


def calibrate(model: SubsequenceSvm, margin: np.ndarray, label: np.ndarray) -> None:
    """Logistic curve of the label over a text's margin, on the fitted sample."""
    x = np.maximum(margin, -2.0)
    a = np.stack([x, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (label - p) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(beta[0]), float(beta[1])


def held_out(column: str):
    """crc32 of the id's decimal text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample_docs: int = SAMPLE_DOCS, train_words: int = TRAIN_WORDS) -> SubsequenceSvm:
    """Classifier from at most ``sample_docs`` labelled rows outside the held-out fifth."""
    spark = docs.sparkSession
    marked = (labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic")))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(F.broadcast(sample), "id"), "labelled")  # sample_docs rows at most
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or len(sizes) < 2:
        rate = 1.0 if sizes.get(1) else 0.0
        return SubsequenceSvm(np.zeros(CELLS), 0.0, 0.0, 40.0 if rate else -40.0)
    listed = F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"))
    stats = (sample.select("toxic", F.explode(listed).alias("word")).filter("length(word) between 3 and 40")
             .groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
             )
    stats = materialize(stats, "wordstats")
    lean = F.log((F.col("pos") + 1.0) / (F.col("neg") + 1.0)) * F.sqrt(F.col("pos") + 0.0)
    picked = (stats.filter("pos + neg >= 5").orderBy(lean.desc(), "word").limit(train_words // 4)
              .unionByName(stats.orderBy((F.col("pos") + F.col("neg")).desc(), "word").limit(train_words // 4))
              .unionByName(stats.orderBy(F.xxhash64("word"), "word").limit(train_words // 2)).distinct())
    edged = F.concat(F.lit("^"), "word")
    inside = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - PART + 1, F.lit(1))),
                                          lambda i: F.substr(edged, i, F.lit(PART))))
    parted = stats.filter(F.length("word") >= PART - 1).select("word", "pos", "neg", F.explode(inside).alias("part"))
    favoured = (parted.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 5")
                .orderBy((F.log((F.col("pos") + 1.0) / (F.col("neg") + 1.0) * (sizes[0] / sizes[1]))
                          * F.sqrt(F.col("pos") + 0.0)).desc(), "part").limit(PARTS).select("part"))
    picked = picked.unionByName(parted.join(F.broadcast(favoured), "part", "left_semi").select("word", "pos", "neg").distinct()
                                .orderBy(F.xxhash64("word"), "word").limit(train_words // 2)).distinct()
    train = {r["word"]: (r["word"], float(r["pos"]), float(r["neg"])) for r in picked.collect()}
    model = fit_words(list(train.values()))
    for _ in range(HARD_ROUNDS):  # words of other texts that the model takes for toxic ones join the training words
        alike = margins(stats.filter("neg > pos").select(F.lit(0).alias("id"), "word", "pos", "neg"),
                        model, "id", "word", keep=("word", "pos", "neg"))
        for r in alike.orderBy(F.desc("margin"), "word").limit(train_words // 4).collect():
            train[r["word"]] = (r["word"], float(r["pos"]), float(r["neg"]))
        model = fit_words(list(train.values()))
    rows = pooled_rows(sample.select("id", "text", "toxic"), model).orderBy("id").toPandas()
    label, pooled = rows["toxic"].to_numpy(dtype=float), np.stack(rows["pooled"].to_numpy())
    fit_texts(model, pooled, label)
    calibrate(model, pooled @ model.pool[:-1] + model.pool[-1], label)
    return model


def pooled_rows(rows: DataFrame, model: SubsequenceSvm) -> DataFrame:
    """(id, toxic, pooled) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @tidy
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.pooled(buf, off) for _, buf, off in text_blocks([batch], "id", "text", TEXT)]
            value = np.concatenate(parts) if parts else np.zeros((0, 2 * len(LEVELS) + 2))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(list(value), pa.list_(pa.float64()))],
                                             ["id", "toxic", "pooled"])

    return rows.select(F.col("id").cast("long").alias("id"), "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        pool, "id long, toxic int, pooled array<double>")


def margins(df: DataFrame, model: SubsequenceSvm, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, margin, kept columns) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [shared.value.margins(buf, off) for _, buf, off in text_blocks([batch], "id", "text", TEXT)]
            value = np.concatenate(value) if value else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value, pa.float64()),
                                              *[batch.column(k) for k in keep]], ["id", "margin", *keep])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    kept = "".join(f", {k} {dict(rows.dtypes)[k]}" for k in keep)
    return rows.mapInArrow(score, f"id long, margin double{kept}")


def toxicity(docs: DataFrame, model: SubsequenceSvm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_blocks(batches, "doc_id", "text", TEXT):
            p = shared.value.probability(shared.value.margins(buf, off))
            held = [crc_mod5("" if k is None else k) == 0 for k in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))


def without_toxic(docs: DataFrame, model: SubsequenceSvm, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns unchanged, whose score stays below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts, buf, off in text_blocks([batch], text_col, text_col, TEXT):  # passed on block by block
                stays = shared.value.probability(shared.value.margins(buf, off)) < threshold
                yield batch.slice(at, len(texts)).filter(pa.array(stays))
                at += len(texts)

    return docs.mapInArrow(clean, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
