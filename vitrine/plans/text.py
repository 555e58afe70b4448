"""Review-message word counts (N1-N5) and the bad-review extract.

Messages are processed row by row (trap S15: the notebook glued them together
without a separator and printed missing ones as "nan"; here each message is
tokenised on its own and NULLs are skipped).  Tokenising is ``split`` +
``explode``; stop words are removed with a left-anti join; counting is a partial/final aggregate, so
very frequent words never gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stop words the notebook appends to its downloaded list.
EXTRA_STOP_WORDS = [
    "a", "o", "as", "os", "de", "que", "ao", "que", "de", "da", "do", "das", "dos", "em", "na", "no", "nas",
    "nos", "em", "pra", "essa", "esse", "essas", "esses", "meu", "minha", "meus", "minhas", "tá", "ta",
]

# Whitespace as Python's str.split() sees it, spelled out so every regex engine agrees.
WHITESPACE = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
              r"\x{202f}\x{205f}\x{3000}]+")
# Word characters (letters, digits, underscore) for the final ``\w+`` pass.
WORD = r"[\p{L}\p{N}_]+"


def stop_words(spark: SparkSession, words=None) -> DataFrame:
    """Stop-word table (the caller's list, else the notebook's literal words)."""
    ws = sorted(set(words if words is not None else EXTRA_STOP_WORDS))
    return spark.createDataFrame([(w,) for w in ws], "word string")


def normalise(msg: Column) -> Column:
    """Lower case, newline -> space, drop , . ? : !"""
    return F.translate(F.regexp_replace(F.lower(msg), "\n", " "), ",.?:!", "")


def tokens(messages: DataFrame, col: str = "review_comment_message", weight: str | None = None) -> DataFrame:
    """N1 + split on whitespace: one row per token (``token``), with the message's ``weight`` (1 by default)."""
    each = F.col(weight) if weight else F.lit(1).cast("bigint")
    norm = messages.select(normalise(F.col(col)).alias("_m"), each.alias("weight")).filter(F.col("_m").isNotNull())
    return (norm.select(F.explode(F.split(F.col("_m"), WHITESPACE)).alias("token"), "weight")
            .filter(F.col("token") != ""))


def kept_tokens(messages: DataFrame, stops: DataFrame, col: str = "review_comment_message",
                weight: str | None = None) -> DataFrame:
    """Tokens that are not stop words and do not start with ``http``."""
    t = tokens(messages, col, weight).filter(~F.col("token").startswith("http"))
    return t.join(stops.select(F.col("word").alias("token")), "token", "left_anti")


def word_counts(messages: DataFrame, stops: DataFrame, col: str = "review_comment_message",
                weight: str | None = None) -> DataFrame:
    """Counts of ``\\w+`` words inside the kept tokens; a message counts ``weight`` times.

    Weights are summed by token before the words inside are cut out."""
    kept = kept_tokens(messages, stops, col, weight).groupBy("token").agg(F.sum("weight").alias("weight"))
    words = kept.select(F.explode(F.regexp_extract_all(F.col("token"), F.lit(f"({WORD})"), 1)).alias("word"), "weight")
    return words.groupBy("word").agg(F.sum("weight").alias("count"))


def top_words(counts: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent words (ties by word) -- a top-k, limit is the feature."""
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(n)


# ------------------------------------------------------------------ N5 bad reviews

# The 13 columns of the bad-review extract, in the notebook's order.
BAD_REVIEW_COLUMNS = [
    "review_comment_message", "price", "freight_value", "payment_type", "product_description_lenght",
    "review_score", "customer_state", "seller_state", "product_photos_qty", "product_category_name",
    "order_approved_at", "order_estimated_delivery_date", "order_delivered_customer_date",
]


def bad_reviews(wide_outer: DataFrame, threshold: int = 4, columns=None) -> DataFrame:
    """B14 + B11: rows with review_score < threshold, the extract's columns (all of them must exist)."""
    cols = list(columns or BAD_REVIEW_COLUMNS)
    missing = [c for c in cols if c not in wide_outer.columns]
    if missing:
        raise ValueError(f"the extract needs columns that the table has not: {missing}")
    return wide_outer.filter(F.col("review_score") < threshold).select(*cols)


def complete_sample(df: DataFrame, keys, n: int = 250, seed: str = "42") -> DataFrame:
    """B13 + F5: rows complete outside ``keys``, then ``n`` of them by a hash of the seed and the keys.

    The hash depends on the row alone, so any partitioning draws the same sample; each
    task keeps its own n (top-k, no global sort).  ``keys`` are dropped afterwards."""
    cols = [c for c in df.columns if c not in keys]
    drawn = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return df.na.drop("any", subset=cols).withColumn("_r", drawn).orderBy("_r", *cols).limit(n).select(*cols)


def write_semicolon_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: the extract written as ``;``-separated CSV (see ``vitrine.sources.io.write_csv``)."""
    from vitrine.sources.io import write_csv

    write_csv(df, path, sep=";", mode=mode)
