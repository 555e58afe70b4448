"""Batch listing what-if (X1, X3-X6): one output row per scenario.

The dashboard's simulator takes one (photos, characters, freight) triple;
here a table of scenarios is placed against the focus rows in one job:

* X1 placement: appending the scenario and re-ranking N+1 rows gives it rank
  #(length <= characters) + 1 (it sorts after its ties).  That count is a range
  lookup, done by merging the scenarios into the length histogram as
  zero-weight rows and taking the same block prefix sum as the rank operator.
* X3 lookup of the scenario's cell in M22 (one row per cell: bounded by
  photo buckets x sextiles, broadcast), X4 best cell (one row), X5 uplift
  with ``try_divide`` (NULL where the reference would divide by zero), X6 text.

* X2 bounds of the scenario's cell among the N+1 rows (``cell_bounds``).  The cuts depend on
  N+1 alone, and a scenario in a cell always takes the place of the cell's last row:
  so one table of bounds, cut at the shifted ranks, serves every scenario.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import labels
from vitrine.operators.lineage import materialize
from vitrine.operators.rank import (boundary_rows, first_rank, join_null_safe, label_from_index, ntile_index,
                                    prefix_before)
from vitrine.operators.share import best_row
from vitrine.plans.listing import ROW_KEY, SEXTILES, photo_bucket

LEN = "product_description_lenght"


def place_scenarios(sol: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, fotos, caracteres, frete, bucket_photos, quantil_desc)."""
    scenarios = materialize(scenarios.withColumn("_row", F.monotonically_increasing_id()))
    lens = (sol.filter(F.col(LEN).isNotNull()).groupBy(LEN).agg(F.count(F.lit(1)).alias("_w"))
            .select(F.col(LEN).cast("bigint").alias("_k"), F.lit(0).alias("_flag"), "_w",
                    F.lit(-1).cast("bigint").alias("_row")))
    scen = scenarios.filter(F.col("caracteres").isNotNull()).select(
        F.col("caracteres").cast("bigint").alias("_k"), F.lit(1).alias("_flag"),
        F.lit(0).cast("bigint").alias("_w"), "_row")
    n_rows = sol.agg(F.count(LEN)).scalar()
    ranked = (prefix_before(lens.unionByName(scen), [], ["_k", "_flag", "_row"], "_w")
              .filter(F.col("_flag") == 1)
              .withColumn("_rank", F.col("_pb") + 1).withColumn("_n1", n_rows + 1)
              .withColumn("quantil_desc", label_from_index(ntile_index("_rank", "_n1", len(SEXTILES)), SEXTILES))
              .select("_row", "quantil_desc"))
    # joined by row: scenarios that repeat an id stay apart
    return (scenarios.join(ranked, "_row", "left").drop("_row")
            .withColumn("bucket_photos", photo_bucket(F.col("fotos"))))


def shifted_cells(sol: DataFrame, tie_break=ROW_KEY) -> DataFrame:
    """(bucket_photos, quantil_desc, min_c, max_c): character bounds of each cell's rows when one more row
    has joined the cell.

    With N+1 rows sextile s spans the ranks a..b.  The rows of the N that stay in it beside the new one are
    those of rank a to b - 1, wherever in a..b the new row falls: those after it move up by one, out of b."""
    n, keys = len(SEXTILES), [LEN, *tie_break, "_rid"]
    rows = materialize(sol.filter(F.col(LEN).isNotNull()).select("bucket_photos", LEN, *tie_break)
                       .withColumn("_rid", F.monotonically_increasing_id()), "lengths")
    starts = [first_rank("(_n + 1)", k, n, 4, "floor") for k in range(1, n)]
    found = materialize(boundary_rows(rows, [], keys, starts + [f"({r}) - 1" for r in starts]), "cuts")  # at most 2 (n - 1) rows
    own = F.struct(*keys)
    first = found.filter(F.col("_k") < n - 1).agg(F.collect_list(own)).scalar()
    last = found.filter(F.col("_k") >= n - 1).agg(F.collect_list(own)).scalar()
    placed = (rows.withColumn("_first", first).withColumn("_last", last)
              .filter(~F.exists("_last", lambda b: b == own))
              .withColumn("quantil_desc", label_from_index(F.size(F.filter("_first", lambda b: b <= own)), SEXTILES)))
    return placed.groupBy("bucket_photos", "quantil_desc").agg(F.min(LEN).alias("min_c"), F.max(LEN).alias("max_c"))


def cell_bounds(sol: DataFrame, scenarios: DataFrame, tie_break=ROW_KEY) -> DataFrame:
    """Each scenario with the least and most characters of its cell, itself included;
    NULL without characters."""
    placed = place_scenarios(sol, scenarios)
    out = join_null_safe(placed, shifted_cells(sol, tie_break), ["bucket_photos", "quantil_desc"], "left")
    length = F.col("caracteres").cast("bigint")
    return (out.withColumn("min_characters", F.when(length.isNotNull(), F.least("min_c", length)))
            .withColumn("max_characters", F.when(length.isNotNull(), F.greatest("max_c", length)))
            .drop("min_c", "max_c"))


def _pct(x: Column) -> Column:
    # scales::percent on a single value: whole percent
    return F.concat(F.bround(x * F.lit(100.0), 0).cast("bigint").cast("string"), F.lit("%"))


def _na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))


def recommend(sol: DataFrame, cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """X1 + X3-X6 for every scenario."""
    placed = place_scenarios(sol, scenarios)
    cells = materialize(cells, "cells")  # read three times
    cell_keys = ["bucket_photos", "quantil_desc"]
    cur = cells.select(*cell_keys, F.col("prop_quantity").alias("sim_prop_quantity"),
                       F.col("prop_sales").alias("sim_prop_sales"))
    tie = ["bucket_photos", "quantil_desc"]
    best_q = best_row(cells, "prop_quantity", tie).select(
        F.col("bucket_photos").alias("best_bucket_photos"), F.col("quantil_desc").alias("best_quantil_desc"),
        F.col("min_caracters_desc").alias("best_min_caracters_desc"),
        F.col("max_caracters_desc").alias("best_max_caracters_desc"),
        F.col("prop_quantity").alias("best_prop_quantity"))
    best_s = best_row(cells, "prop_sales", tie).select(
        F.col("bucket_photos").alias("best_sales_bucket_photos"),
        F.col("quantil_desc").alias("best_sales_quantil_desc"),
        F.col("min_caracters_desc").alias("best_sales_min_caracters_desc"),
        F.col("max_caracters_desc").alias("best_sales_max_caracters_desc"),
        F.col("prop_sales").alias("best_prop_sales"))
    # best_*: one row each, attached as scalar subqueries
    out = placed.join(cur, cell_keys, "left")
    for best in (best_q, best_s):
        row = best.select(F.struct(*best.columns)).scalar()
        for c in best.columns:
            out = out.withColumn(c, row.getField(c))
    out = (out
           .withColumn("increase_quantity", F.try_divide(F.col("best_prop_quantity") - F.col("sim_prop_quantity"),
                                                         F.col("sim_prop_quantity")))
           .withColumn("increase_sales", F.try_divide(F.col("best_prop_sales") - F.col("sim_prop_sales"),
                                                      F.col("sim_prop_sales")))
           .withColumn("freight_gain_quantity", F.col("frete") * 2 * F.col("increase_quantity"))
           .withColumn("freight_gain_sales", F.col("frete") * 2 * F.col("increase_sales")))
    return with_sentences(out)


def with_sentences(df: DataFrame) -> DataFrame:
    """Current and possible situation sentences, for quantity and for sales.

    Both sales sentences take cell and value from the sales ranking (trap S13
    resolved: the reference prints the quantity-best cell with the sales-best value).
    """
    # Sentence fragments of the simulator (pt-BR).
    cur_a, cur_b, cur_c = ("Você está usando ", " fotos e seu anúncio se encaixa no ",
                           " quantil em termos de caracteres, sua aprovação estimada é de ")
    pos_a, pos_b, pos_c, pos_d, pos_e, pos_f = (
        "Você deveria usar ", " fotos e manter a descrição do produto entre ", " e ",
        " caracteres podendo aumentar sua aprovação para ", " um aumento de ",
        " reduzindo o seu custo por produto em até ")

    def current(prop: str) -> Column:
        return F.concat(F.lit(cur_a), _na(F.col("bucket_photos")), F.lit(cur_b), _na(F.col("quantil_desc")),
                        F.lit(cur_c), _na(_pct(F.col(prop))))

    def possible(prefix: str, prop: str, inc: str, gain: str) -> Column:
        return F.concat(F.lit(pos_a), _na(F.col(f"{prefix}bucket_photos")), F.lit(pos_b),
                        _na(F.col(f"{prefix}min_caracters_desc")), F.lit(pos_c),
                        _na(F.col(f"{prefix}max_caracters_desc")), F.lit(pos_d), _na(_pct(F.col(prop))),
                        F.lit(pos_e), _na(_pct(F.col(inc))), F.lit(pos_f), _na(labels.reais(F.col(gain), digits=None)))

    return (df.withColumn("current_situation_quantity", current("sim_prop_quantity"))
            .withColumn("possible_situation_quantity",
                        possible("best_", "best_prop_quantity", "increase_quantity",
                                 "freight_gain_quantity"))
            .withColumn("current_situation_sales", current("sim_prop_sales"))
            .withColumn("possible_situation_sales",
                        possible("best_sales_", "best_prop_sales", "increase_sales",
                                 "freight_gain_sales")))
