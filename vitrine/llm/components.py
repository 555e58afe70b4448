"""Connected components of a link table by minimum labels and pointer jumping.

Every round is two joins and two partial aggregations over the links; a vertex
with very many links is one row on the unique side of a join, which adaptive
execution splits.  Labels are written to the shared folder each round, so the
lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex in ``links`` (a, b); the component is its smallest id."""
    both = materialize(links.select("a", "b").filter("a <> b")
                       .unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b"))
                       .distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id"))
                         .agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        # the smallest label around a vertex also moves the vertex that its old label names
        moved = materialize(labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next")),
                            "moved")
        if moved.filter("next <> component").isEmpty():
            return labels
        hook = moved.groupBy(F.col("component").alias("id")).agg(F.min("next").alias("hook"))
        hooked = moved.join(hook, "id", "left").select("id", F.least("next", F.coalesce("hook", "next")).alias("next"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        labels = materialize(hooked.join(jump, "next", "left")
                             .select("id", F.least("next", F.coalesce("jump", "next")).alias("component")), "labels")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that ``links`` (a, b) connect made one: only links between components are followed."""
    def of(column: str) -> DataFrame:
        return labels.select(F.col("id").alias(column), F.col("component").alias(f"{column}_component"))

    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
               .filter("a <> b").distinct())
    roots = components(between)
    moved = (labels.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
             .select("id", F.coalesce("root", "component").alias("component")))
    return materialize(moved.unionByName(roots.join(labels, "id", "left_anti").select("id", "component")), "labels")
