"""Secret scan: candidates, features and a random forest, all in DataFrame operations.

A candidate is a run of at least ``SHORTEST`` characters of the kind that keys are made of, or
a value of at least ``SHORTEST_NAMED`` characters of any kind behind a credential's name and "=" or ":".
A name that is written onto the value ("API_KEY=9f8e...") is split off and is one of the
neighbouring words.  Features of a candidate: length, transitions between character classes, the
share of it that words of the corpus cover, whether it looks like a path or an address, and its
neighbouring words.  A random forest (Spark ML, on the JVM) trained from labelled findings tells
secrets from look-alikes.

``labelled_findings`` makes the training rows where no labels exist.  1: a mixed value that is
assigned to a credential's name; the well-known key forms of ``KEY_FORMS`` standing alone, filled
from digests of the corpus's candidates.  0: plain words, placeholders, addresses, numbers and
paths, named or not.  At most ``TRAIN_ROWS`` rows of either label are used (a documented bound of
the classifier), those whose hash modulo 5 is 0 are held out (``held_out_figures``).  The dictionary
is a table of all words in at least ``IN_DOCUMENTS`` documents, joined to the candidates' word
parts; it, the candidates and the scores cover every text.

Defined cases: null and empty texts have no candidates; a text has as many rows as candidates,
repeats included, told apart by their position; with fewer than ``LEAST_FINDINGS`` of either label the
score is the rule's label, 0 where it does not decide; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

#: A bare run below this length is no key; behind a credential's name shorter values count too.
SHORTEST, SHORTEST_NAMED = 16, 6
TRAIN_ROWS = 20_000
#: Names that credentials are assigned to.
CREDENTIAL_NAMES = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key",
                    "auth", "credential", "private_key", "client_secret"]
#: What stands for a value that is not there.
PLACEHOLDERS = ["null", "none", "true", "false", "undefined", "required", "optional", "example", "changeme", "string"]
#: Well-known key forms; each takes its filling from a digest (hexadecimal, upper case, or base 64).
KEY_FORMS = [("AKIA", "upper", 16, ""), ("ghp_", "base", 36, ""), ("xoxb-", "digits", 24, ""), ("sk_live_", "base", 24, ""),
             ("AIza", "base", 35, ""), ("eyJ", "base", 60, ".eyJzdWIiOiIx"), ("", "base", 40, ""), ("", "mixed", 32, "")]
#: Findings of each key form.
OF_EACH_FORM = 300
#: Findings of either label that a forest needs at least.
LEAST_FINDINGS = 10
#: Documents that a word of the dictionary occurs in at least.
IN_DOCUMENTS = 5
#: Characters before and after a candidate that count as its neighbours.
BEFORE, AFTER = 60, 40
MASK = "[SECRET]"

CHARS = r"[A-Za-z0-9+/=_.@:\-]"
RUN = CHARS + "{%d,}" % SHORTEST
NAMED = r"""[^\s"',;]{%d,}""" % SHORTEST_NAMED
_NAMES = "|".join(CREDENTIAL_NAMES)
#: What stands between a credential's name and its value.
ASSIGNED = r"""(?i:%s)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?""" % _NAMES
#: Where a text is cut: before every maximal run, behind a name and "=" in a run, behind an assigned credential's name.
CUT = (rf"(?<!{CHARS})(?={RUN})|(?<==)(?<=[A-Za-z_][A-Za-z0-9_]{{1,30}}=)(?={RUN})"
       rf"""|(?<=[=:"' \t])(?<={ASSIGNED})(?={NAMED})""")
FEATURES = ["length", "lower", "upper", "digit", "symbol", "transitions", "hexadecimal", "distinct", "coverage",
            "is_path", "is_address", "named", "assigned", "quoted", "neighbour_letters"]


def leading(piece, before):
    """The candidate that a piece of a text begins with, given the piece before it; empty if none."""
    named = F.regexp_extract(piece, f"^({NAMED})", 1)
    return F.when(before.rlike(f"{ASSIGNED}$"), named).otherwise(F.regexp_extract(piece, f"^({RUN})", 1))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, place, before, candidate, after): every candidate of every text with the text around it."""
    cut = (df.filter(F.col(text_col).rlike(f"{RUN}|{ASSIGNED}"))
           .select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text_digest"), F.split(text_col, CUT).alias("pieces")))

    def found(piece, i):
        prior = F.when(i > 0, F.get("pieces", i - 1)).otherwise("")
        own = leading(piece, prior)
        return F.struct(i.cast("long").alias("place"), F.right(prior, F.lit(BEFORE)).alias("before"), own.alias("candidate"),
                        F.substr(piece, F.length(own) + 1, F.lit(AFTER)).alias("after"))

    pieces = cut.select("id", "text_digest", F.inline(F.transform("pieces", found)))
    return pieces.filter("candidate <> ''")


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(part): every word of three letters or more, in lower case, that enough documents hold."""
    listed = F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"))
    return (df.select(F.explode(listed).alias("part")).filter("length(part) > 2").groupBy("part")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= IN_DOCUMENTS).select("part"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, covered): characters of each distinct candidate that lie in words of the dictionary."""
    parts = F.regexp_extract_all("candidate", F.lit(r"(\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,})"), F.lit(1))
    each = found.select("candidate").distinct().select("candidate", F.explode(parts).alias("part"))
    each = each.select("candidate", F.lower("part").alias("part"), F.length("part").alias("size"))
    return each.join(words, "part").groupBy("candidate").agg(F.sum("size").alias("covered"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with one double column per feature."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    changes = F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1

    def share(pattern: str):
        return F.length(F.regexp_replace(c, pattern, "")) / n

    covered = coverage(found, words).withColumnRenamed("candidate", "of_candidate")
    rows = found.join(covered, F.col("candidate") == F.col("of_candidate"), "left")
    return rows.select(
        *found.columns, n.alias("length"),
        share("[^a-z]").alias("lower"), share("[^A-Z]").alias("upper"), share("[^0-9]").alias("digit"),
        share("[A-Za-z0-9]").alias("symbol"), (changes / n).alias("transitions"),
        c.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        c.rlike(r"/.*/|^[A-Za-z]:|^\.{1,2}/").cast("double").alias("is_path"),
        c.rlike(r"@|://|^[0-9.:]+$|\.(com|org|net|html?)$").cast("double").alias("is_address"),
        F.col("before").rlike(f"{ASSIGNED}$").cast("double").alias("named"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double").alias("quoted"),
        (F.length(F.regexp_replace("before", r"[^\p{L}]", "")) / F.greatest(F.length("before"), F.lit(1))
         ).alias("neighbour_letters"))


def rule_label():
    """1.0, 0.0 or null where the rule does not decide."""
    c = F.col("candidate")
    mixed = (F.col("digit") > 0.05) & (F.col("lower") + F.col("upper") > 0.05) & (F.col("is_path") == 0) & (F.col("coverage") < 0.6)
    plain = ((F.col("is_address") == 1) | (F.col("is_path") == 1) | (F.col("digit") == 1)
             | ((F.col("digit") == 0) & (F.col("coverage") > 0.4)) | F.lower(c).isin(*PLACEHOLDERS) | c.rlike(r"^[<${]"))
    unnamed = (F.col("named") == 0) & ((F.col("digit") == 0) | (F.col("coverage") > 0.6))
    return (F.when((F.col("named") == 1) & mixed, 1.0)
            .when((F.col("named") == 1) & (F.lower(c).isin(*PLACEHOLDERS) | c.rlike(r"^[<${]")
                                           | ((F.col("digit") == 0) & (F.col("coverage") > 0.6))), 0.0)
            .when((F.col("named") == 0) & (plain | unnamed), 0.0))


def key_forms(found: DataFrame) -> DataFrame:
    """Candidates of the well-known forms, standing alone; their fillings are digests of found candidates."""
    seed = (found.select("candidate").distinct().orderBy(F.xxhash64("candidate"), "candidate").limit(OF_EACH_FORM)
            .withColumn("digest", F.sha2("candidate", 512)))
    base = F.regexp_replace(F.base64(F.unhex("digest")), "[+/=]", "x")
    fill = {"upper": F.upper(F.translate(base, "abcdefghij", "KLMNOPQRST")), "base": base, "digits": F.translate("digest", "abcdef", "123456"),
            "mixed": F.translate("digest", "abcdef", "gXkZpW")}
    rows = None
    for head, kind, size, end in KEY_FORMS:
        part = seed.select(F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.lit("").alias("text_digest"),
                           F.lit(0).cast("long").alias("place"), F.lit(" ").alias("before"),
                           F.concat(F.lit(head), F.substring(fill[kind], 1, size), F.lit(end)).alias("candidate"), F.lit(" ").alias("after"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def labelled_findings(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with a label by rule (undecided ones are left out), and the key forms with label 1."""
    ruled = found.withColumn("label", rule_label()).filter("label is not null")
    return ruled.unionByName(features(key_forms(found), words).withColumn("label", F.lit(1.0)))


def held_out():
    """A fifth of the candidates, by a hash of their text: equal ones are on one side."""
    return F.pmod(F.xxhash64("candidate"), F.lit(5)) == 0


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 6):
    """Random forest over ``FEATURES``; None with fewer than ``LEAST_FINDINGS`` of either label."""
    sample = None
    for label in (0.0, 1.0):
        part = (labelled.filter(F.col("label") == label).filter(~held_out())
                .orderBy(F.xxhash64("candidate", "id", "place"), "candidate", "place").limit(rows))
        sample = part if sample is None else sample.unionByName(part)
    sample = materialize(sample.select(*FEATURES, "label"), "findings")
    sizes = sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FINDINGS)
    if sizes.count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def scored_by(model, found: DataFrame, threshold: float) -> DataFrame:
    if model is None:
        scored = found.withColumn("score", F.coalesce(rule_label(), F.lit(0.0)))
    else:
        scored = (model.transform(found).withColumn("score", vector_to_array("probability")[1])
                  .drop("features", "rawPrediction", "probability", "prediction"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def held_out_figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(label, named, n, flagged) of the labelled findings that the forest has not seen."""
    words = materialize(dictionary(df, text_col), "dictionary")
    found = materialize(features(candidates(df, id_col, text_col), words), "candidates")
    labelled = materialize(labelled_findings(found, words), "labelled")
    scored = scored_by(train(labelled), labelled.filter(held_out()), threshold)
    return scored.groupBy("label", "named").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_secret").cast("long")).alias("flagged"))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
                threshold: float = 0.5) -> DataFrame:
    """(id, text_digest, place, before, candidate, after, features, score, is_secret): one row per candidate.

    ``labelled``: findings with ``FEATURES``, id, place, candidate and ``label``; by default
    ``labelled_findings`` of the same texts."""
    words = materialize(dictionary(df, text_col), "dictionary")
    found = materialize(features(candidates(df, id_col, text_col), words), "candidates")
    model = train(labelled_findings(found, words) if labelled is None else labelled)
    return scored_by(model, found, threshold)


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """The same rows and columns with every found secret replaced by ``MASK``.

    The text is cut at the candidates again, and each place decides for itself.  Rows with equal
    texts share their places; the names used inside are unlike any column's."""
    found = (secret_scan(df, id_col, text_col, labelled).filter("is_secret")
             .groupBy("text_digest").agg(F.collect_set("place").alias("places")))
    key, digest, places = (f"{n}_{uuid.uuid4().hex}" for n in ("key", "digest", "places"))
    found = found.select(F.col("text_digest").alias(digest), F.col("places").alias(places))
    pieces = F.split(text_col, CUT)

    def masked(piece, i):
        prior = F.when(i > 0, F.get(pieces, i - 1)).otherwise("")
        rest = F.substr(piece, F.length(leading(piece, prior)) + 1, F.length(piece))
        return F.when(F.array_contains(places, i.cast("long")), F.concat(F.lit(MASK), rest)).otherwise(piece)

    rows = df.withColumn(key, F.sha2(text_col, 256)).join(found, F.col(key) == F.col(digest), "left")
    text = F.when(F.col(places).isNotNull(), F.array_join(F.transform(pieces, masked), "")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*[f"`{c}`" for c in df.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document; texts of secrets leave as digests."""
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "place", F.col("length").cast("long").alias("n_chars"),
                      F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
