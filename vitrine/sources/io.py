"""Readers and writers for the marketplace's own files.

The reference reads eight CSV files with inferred types; here every table has
an explicit schema (no inference pass over the data, stable types across
files).  The state spreadsheet and the state polygons have no Spark source:
they are taken as CSV/Parquet tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

# Canonical schemas of the CSV inputs (columns the analyses use, in file order).
SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, "
              "order_approved_at timestamp, order_delivered_carrier_date timestamp, "
              "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
                   "shipping_limit_date timestamp, price decimal(18,2), freight_value decimal(18,2)",
    "payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, "
                "payment_value decimal(18,2)",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
               "review_comment_message string, review_creation_date timestamp, review_answer_timestamp timestamp",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
                "product_description_lenght int, product_photos_qty int, product_weight_g int, "
                "product_length_cm int, product_height_cm int, product_width_cm int",
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
                 "customer_city string, customer_state string",
    "sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    "geolocation": "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, "
                   "geolocation_city string, geolocation_state string",
    "states": "Sigla string, Estado string, Region string",
    "state_map": "nome string, geometry string",
    "category_translation": "product_category_name string, product_category_name_english string",
}


#: Tables whose text may hold line breaks.  Spark reads such a file in one task; the others are split.
MULTILINE = ("reviews",)
#: Columns that the sources hold as text dates: bad ones become NULL and reject no row.
TEXT_DATES = {"orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
                         "order_delivered_customer_date", "order_estimated_delivery_date"]}


#: What a quoted empty field reads as, to tell it from a missing one.
EMPTY = "\u0001"


def _scan(spark: SparkSession, path: str, schema: str, sep: str, multiline: bool, **options) -> DataFrame:
    rows = (spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", multiline)
            .option("escape", '"').option("emptyValue", EMPTY).options(**options).csv(path))
    return rows.withColumns({c: F.when(F.col(c) == EMPTY, F.lit("")).otherwise(F.col(c))
                             for c, kind in rows.dtypes if kind == "string"})


def read_csv(spark: SparkSession, name: str, path: str, sep: str = ",", schema: str | None = None,
             multiline: bool | None = None) -> DataFrame:
    """A1 (and A2/A3 when the state tables are exported to CSV): header CSV with a fixed schema.

    Quoted line breaks are only looked for where a table may hold them (``MULTILINE``)."""
    multiline = name in MULTILINE if multiline is None else multiline
    return _scan(spark, path, schema or SCHEMAS[name], sep, multiline)


def read_csv_checked(spark: SparkSession, name: str, path: str, sep: str = ",", schema: str | None = None,
                     multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """A1 with a reject table: the good rows, and (line) of rows that do not fit the schema.

    Text dates (``TEXT_DATES``) are read as text and coerced (H15); only other columns reject a row.
    Read once: both tables come from one written scan."""
    fields = [f.strip().rsplit(" ", 1) for f in (schema or SCHEMAS[name]).split(", ")]
    dates = TEXT_DATES.get(name, [])
    raw = ", ".join(f"{c} {'string' if c in dates else kind}" for c, kind in fields) + ", _reject string"
    multiline = name in MULTILINE if multiline is None else multiline
    rows = materialize(_scan(spark, path, raw, sep, multiline, mode="PERMISSIVE", columnNameOfCorruptRecord="_reject"), "csv")
    good = rows.filter(F.col("_reject").isNull()).drop("_reject")
    good = good.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in dates if c in good.columns})
    return good, rows.filter(F.col("_reject").isNotNull()).select(F.col("_reject").alias("line"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2/A3: the state list / state geometry as Parquet (or any Spark format)."""
    return spark.read.format(fmt).load(path)


def translate_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """A4: add ``product_category_name_english`` (NULL without a translation)."""
    return products.join(translation, "product_category_name", "left")


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """A5: ``to_csv(sep=';')`` as a Spark CSV sink (no index column): quotes are doubled, blanks at
    either end and line breaks stay, an empty text is quoted and NULL is not."""
    (df.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """``head()`` -- a limit is the feature."""
    return df.limit(n)


def scalar(df: DataFrame):
    """``pull()`` of a one-row result, at the edge only (one row by construction)."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"expected one row, got {len(row)}")
    return row[0][0]


def columns(df: DataFrame) -> list[str]:
    """Column listing."""
    return list(df.columns)


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``add_row`` -- union by name, missing columns NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


def with_geolocation(customers: DataFrame, geo: DataFrame) -> DataFrame:
    """C11 (commented out in the reference): customers with the mean coordinates
    of their zip prefix.  Geo rows are reduced to one per prefix first, so the
    left join cannot fan out."""
    per_zip = geo.groupBy("geolocation_zip_code_prefix").agg(
        F.avg("geolocation_lat").alias("geolocation_lat"), F.avg("geolocation_lng").alias("geolocation_lng"))
    return customers.join(per_zip, customers.customer_zip_code_prefix == per_zip.geolocation_zip_code_prefix,
                          "left").drop("geolocation_zip_code_prefix")


def delivery_days(df: DataFrame) -> DataFrame:
    """H18 (a comment in the notebook): days from purchase to delivery."""
    return df.withColumn("delivery_days", F.date_diff(F.col("order_delivered_customer_date"),
                                                      F.col("order_purchase_timestamp")))
