"""Sources and sinks."""

from __future__ import annotations

import datetime as dt

from vitrine.sources import io


def test_csv_with_fixed_schema_and_multiline_messages(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"muito bom,\nchegou rápido",2018-01-01 00:00:00,2018-01-02 10:00:00\n'
        "r2,o2,,,,2018-01-03 00:00:00,2018-01-04 00:00:00\n", encoding="utf-8")
    df = io.read_csv(spark, "reviews", str(p))
    rows = {r.review_id: r for r in df.collect()}
    assert rows["r1"].review_comment_message == "muito bom,\nchegou rápido"
    assert rows["r1"].review_score == 5 and rows["r2"].review_score is None
    assert dict(df.dtypes)["review_creation_date"] == "timestamp"


def test_translation_csv_with_bom_header(spark, tmp_path):
    p = tmp_path / "translation.csv"
    p.write_bytes("﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"
                  .encode("utf-8"))
    tr = spark.read.option("header", True).csv(str(p))
    assert tr.columns == ["product_category_name", "product_category_name_english"]
    prods = spark.createDataFrame([("p1", "beleza_saude"), ("p2", None)], "product_id string, product_category_name string")
    got = {r.product_id: r.product_category_name_english for r in io.translate_categories(prods, tr).collect()}
    assert got == {"p1": "health_beauty", "p2": None}


def test_semicolon_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.5), ("c", None)], "msg string, price double")
    out = str(tmp_path / "out")
    io.write_csv(df, out)
    back = spark.read.option("sep", ";").option("header", True).schema("msg string, price double").csv(out)
    assert sorted(back.collect(), key=lambda r: r.msg) == sorted(df.collect(), key=lambda r: r.msg)


def test_small_helpers(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert io.preview(df).count() == 5
    assert io.scalar(df.agg({"x": "max"})) == 9
    assert io.columns(df) == ["x"]
    extra = spark.createDataFrame([(99, "new")], "x long, note string")
    both = io.append_rows(df, extra)
    assert both.count() == 11 and both.filter("note = 'new'").count() == 1


def test_geolocation_join_does_not_fan_out(spark):
    cust = spark.createDataFrame([("c1", "01000"), ("c2", "99999")], "customer_id string, customer_zip_code_prefix string")
    geo = spark.createDataFrame([("01000", -23.0, -46.0), ("01000", -23.2, -46.2)],
                                "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double")
    rows = {r.customer_id: r for r in io.with_geolocation(cust, geo).collect()}
    assert len(rows) == 2 and abs(rows["c1"].geolocation_lat + 23.1) < 1e-12 and rows["c2"].geolocation_lat is None


def test_delivery_days(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 1, 23), dt.datetime(2018, 1, 5, 1))],
                               "order_purchase_timestamp timestamp, order_delivered_customer_date timestamp")
    assert io.delivery_days(df).first().delivery_days == 4


def test_rejects_are_kept_beside_the_good_rows(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
                 "order_delivered_customer_date,order_estimated_delivery_date\n"
                 "1,10,delivered,2018-01-01 10:00:00,bad,,2018-13-40,2018-02-01\n"
                 "x,10,delivered,2018-01-01 10:00:00,,,,\n"
                 "2,11,shipped,2018-01-02 10:00:00,2018-01-03 00:00:00,,,too,many,columns\n", encoding="utf-8")
    schema = ("order_id bigint, customer_id bigint, order_status string, order_purchase_timestamp timestamp, "
              "order_approved_at timestamp, order_delivered_carrier_date timestamp, "
              "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp")
    good, rejects = io.read_csv_checked(spark, "orders", str(p), schema=schema)
    one = good.collect()
    assert [r.order_id for r in one] == [1] and one[0].order_approved_at is None and one[0].order_delivered_customer_date is None
    assert one[0].order_estimated_delivery_date == dt.datetime(2018, 2, 1)
    assert rejects.count() == 2 and rejects.filter("line like 'x,%'").count() == 1


def test_written_table_comes_back_equal(spark, tmp_path):
    rows = [(1, 'a "quoted" ; text\nwith breaks\r\nand more'), (2, ""), (3, None), (4, "  blanks  "), (5, "\\"), (6, 'end"'),
            (7, "x" * 300_000), (8, ",;\t"), (9, "não é")]
    schema = "review_id bigint, review_comment_message string"
    df = spark.createDataFrame(rows, schema)
    io.write_csv(df, str(tmp_path / "out"))
    good, rejects = io.read_csv_checked(spark, "reviews", str(tmp_path / "out"), sep=";", schema=schema)
    assert {r[0]: r[1] for r in good.collect()} == dict(rows) and rejects.count() == 0


def test_order_files_are_split_and_messages_are_not(spark, tmp_path):
    lines = "\n".join(f"{k},{k},delivered,2018-01-01 10:00:00,,,," for k in range(60_000))
    (tmp_path / "orders.csv").write_text("a,b,c,d,e,f,g,h\n" + lines, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert io.read_csv(spark, "orders", str(tmp_path / "orders.csv")).rdd.getNumPartitions() > 4
        assert io.read_csv(spark, "orders", str(tmp_path / "orders.csv"), multiline=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
