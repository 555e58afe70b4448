"""Exact dedup against a persistent digest index.

The index is a Parquet table of (digest, keep_id), bucketed and sorted by
digest.  New rows are reduced to one row per digest before any shuffle, removed
by a sort-merge anti-join when the index already has their digest, and the rest
is appended.  A digest is the SHA-256 of the text; null counts as empty.

Defined cases: an empty table gives no rows; a null id takes part, keeps its
digest only if no row of the group has an id, and is reported with kept = false
unless the whole group has null ids; rows that repeat both id and text share
one decision; other columns of the input are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

#: A group is hot when it has this share of all rows, so at most 1 / share groups are.
HOT_SHARE = 0.001


class DigestIndex:
    """Bucketed table of the digests seen so far; it outlives the DataFrames made from it."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> DataFrame:
        """Append the digests of ``rows`` (id, digest) that the index does not have; returns them."""
        new = rows.groupBy("digest").agg(F.max("id").alias("keep_id"))
        if self.exists():
            new = new.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = materialize(new, "digests")
        # a bucket goes to one task, whatever their number: one file per bucket and append
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (new.repartition(self.buckets, bucket).write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        return new

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                index: DigestIndex | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) per row; of equal texts the largest id stays.

    Without an index a new one is made.  The upper half of the id range goes in
    first, so the first owner of a digest is also the largest id."""
    spark = df.sparkSession
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    rows = materialize(digests(df, id_col, text_col), "rows")
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if low is None:
        index.add(rows)
    else:
        upper = F.coalesce(F.col("id") > F.lit((low + high) // 2), F.lit(False))
        index.add(rows.filter(upper))
        index.add(rows.filter(~upper))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialize(index.rows().join(sizes, "digest"), "groups")
    # at most 1 / HOT_SHARE groups hold HOT_SHARE of the rows each: a proven bound for a broadcast
    is_hot = F.col("group_size") >= max(2.0, HOT_SHARE * total)
    hot = F.broadcast(groups.filter(is_hot))
    named = ("id", "keep_id", "group_size", "digest")
    out = (rows.join(hot, "digest").select(*named)
           .unionByName(rows.join(hot, "digest", "left_anti")
                        .join(groups.filter(~is_hot), "digest").select(*named)))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns unchanged; of rows that repeat both id and text one stays."""
    key = {"id0": F.coalesce("id", F.lit(0)), "no_id": F.col("id").isNull(), "digest": F.col("digest")}
    names, kept = ({k: f"{k}_{uuid.uuid4().hex}" for k in key} for _ in range(2))
    stay = exact_dedup(df, id_col, text_col).filter("kept").select(*[c.alias(kept[k]) for k, c in key.items()])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumns({names["id0"]: F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
                           names["no_id"]: F.col(id_col).isNull(), names["digest"]: F.unhex(F.sha2(text, 256))})
    same = [F.col(names[k]) == F.col(kept[k]) for k in key]
    return rows.join(stay, same, "left_semi").dropDuplicates(list(names.values())).select(*[f"`{c}`" for c in df.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
