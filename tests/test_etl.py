"""The data preparation on the hand-made shop."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketlens.functions.spherical import haversine_km
from marketlens.functions.text import pad_zip
from marketlens.functions.timing import days_between, hours_between, months_between_starts
from marketlens.plans import etl, job, quality, rollups
from marketlens.sources.raw import RAW_SCHEMAS, read_csv, read_raw
from tests.shop import TABLES


@pytest.fixture(scope="module")
def raw(spark, shop_csv):
    return read_raw(spark, shop_csv)


@pytest.fixture(scope="module")
def items(shop):
    return {(r["order_id"], r["order_item_id"]): r for r in shop.collect()}


def test_every_raw_table_keeps_its_rows_and_columns(raw):
    for table, rows in TABLES.items():
        assert raw[table].columns == rows[0]
        assert raw[table].count() == len(rows) - 1
        types = dict(raw[table].dtypes)
        for name, kind in RAW_SCHEMAS[table].items():
            assert types[name] == ("string" if kind == "zip" else kind)


def test_a_zip_code_is_padded_and_never_cut(spark):
    codes = spark.createDataFrame([("7",), ("1046",), ("12345",), ("123456",), (None,)], "z string")
    assert [r[0] for r in codes.select(pad_zip(F.col("z"))).collect()] == ["00007", "01046", "12345", "123456", None]


def test_unreadable_timestamps_and_null_words_become_null(raw):
    approved = {r["order_id"]: r["order_approved_at"] for r in raw["orders"].collect()}
    assert approved["o1"] == datetime(2017, 1, 1, 12)
    assert approved["o3"] is None and approved["o4"] is None
    comments = {r["review_score"]: r["review_comment"] for r in raw["order_reviews"].collect()}
    assert comments == {1: 'late,\nand "broken"', 4: None, 5: "fine", 3: None}


def test_a_bad_number_is_an_error(spark, tmp_path):
    path = tmp_path / "order_payments.csv"
    path.write_text("order_id,payment_type,payment_installments,payment_value\no1,boleto,1,much\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, "order_payments", str(path)).collect()


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("seller_id,seller_city\ns1,recife\n")
    with pytest.raises(ValueError, match="seller_state"):
        read_csv(spark, "sellers", str(path))


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "category_translation.csv"
    path.write_text("product_category_name_english,product_category_name\nbooks,livros\n")
    row = read_csv(spark, "category_translation", str(path)).first()
    assert row["product_category_name"] == "livros"


def test_raw_tables_can_have_any_path(spark, shop_csv):
    paths = {table: f"{shop_csv}/{table}.csv" for table in RAW_SCHEMAS}
    assert read_raw(spark, paths)["sellers"].count() == 2


def test_centroids(raw):
    found = {r["zip"]: r for r in etl.geo_centroids(raw["geolocation"]).collect()}
    assert set(found) == {"01046", "20000"}
    assert (found["01046"]["lat"], found["01046"]["lng"]) == (-23.625, -46.625)
    assert found["01046"]["city"] == "sao paulo"  # the smaller of two tied names
    assert (found["20000"]["city"], found["20000"]["state"]) == ("rio", "RJ")


def test_reviews_and_payments_per_order(raw):
    reviews = {r["order_id"]: tuple(r)[1:] for r in etl.review_summary(raw["order_reviews"]).collect()}
    assert reviews == {"o1": (2.5, 1, 2), "o2": (5.0, 5, 1), "o4": (3.0, 3, 1)}
    payments = {r["order_id"]: tuple(r)[1:] for r in etl.payment_summary(raw["order_payments"]).collect()}
    assert payments == {"o1": (1070.0, 13, "credit_card"), "o2": (5.5, 0, "coupon"), "o3": (150.0, 1, "boleto")}


def test_the_fact_has_one_row_per_item(items):
    assert sorted(items) == [("o1", 1), ("o1", 2), ("o2", 1), ("o3", 1), ("o4", 1)]


def test_the_fact_has_the_documented_columns(shop):
    assert shop.columns == [*etl.FACT_COLUMNS, *etl.DERIVED_COLUMNS]
    assert len(etl.FACT_COLUMNS) == 32 and len(etl.DERIVED_COLUMNS) == 9
    types = dict(shop.dtypes)
    assert types["price"] == types["delay_days"] == types["seller_customer_distance_km"] == "float"
    assert types["is_late"] == "boolean" and types["order_year_month"] == "date"
    assert types["order_purchase_timestamp"] == "timestamp_ntz" and types["max_installments"] == "int"


def test_attributes_come_from_every_side(items):
    item = items["o1", 2]
    assert item["product_category_name_english"] == "furniture"
    assert (item["seller_state"], item["customer_state"], item["customer_unique_id"]) == ("PE", "SP", "u1")
    assert (item["avg_review_score"], item["min_review_score"], item["review_count"]) == (2.5, 1, 2)
    assert (item["total_payment"], item["max_installments"], item["primary_payment_type"]) == (1070.0, 13, "credit_card")
    assert items["o3", 1]["product_category_name"] == "raro"
    assert items["o3", 1]["product_category_name_english"] is None
    assert items["o4", 1]["primary_payment_type"] is None and items["o3", 1]["avg_review_score"] is None


def test_value_and_freight_share(items):
    assert items["o1", 1]["total_item_value"] == 50.0
    assert items["o1", 1]["freight_ratio"] == 0.25
    assert items["o2", 1]["freight_ratio"] is None


def test_lifecycle(items):
    late, exact, shipped = items["o1", 1], items["o2", 1], items["o3", 1]
    assert (late["approval_wait_hours"], late["carrier_wait_hours"]) == (2.0, 24.0)
    assert (late["transit_days"], late["delay_days"], late["is_late"]) == (9.0, 1.5, True)
    assert exact["carrier_wait_hours"] == -12.0
    assert (exact["delay_days"], exact["is_late"]) == (0.0, False)
    assert (shipped["delay_days"], shipped["is_late"], shipped["approval_wait_hours"]) == (None, False, None)
    assert late["order_year_month"] == date(2017, 1, 1)


def test_parts_of_a_second_count(spark):
    row = spark.sql(
        "SELECT TIMESTAMP_NTZ '2020-01-01 00:00:00.5' AS a, TIMESTAMP_NTZ '2020-01-01 01:00:00.25' AS b"
    ).select(hours_between("b", "a").alias("h"), days_between("a", "b").alias("d")).first()
    assert row["h"] == pytest.approx(3599.75 / 3600, rel=1e-15)
    assert row["d"] == pytest.approx(-3599.75 / 86400, rel=1e-15)


def test_distance(spark, items):
    assert items["o1", 2]["seller_customer_distance_km"] is None  # seller not located
    assert items["o2", 1]["seller_customer_distance_km"] == 0.0

    def great_circle(lat1, lng1, lat2, lng2):
        a, b, c, d = map(math.radians, (lat1, lng1, lat2, lng2))
        return 6371.0 * math.acos(math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b))

    expected = great_circle(-22.5, -43.25, -23.625, -46.625)
    assert items["o1", 1]["seller_customer_distance_km"] == pytest.approx(expected, rel=1e-6)
    antipodes = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    assert antipodes.select(haversine_km("a", "b", "c", "d")).first()[0] == pytest.approx(math.pi * 6371.0)


def test_months_between(spark):
    row = spark.sql("SELECT DATE '2016-11-01' AS a, DATE '2018-01-01' AS b").select(
        months_between_starts(F.col("a"), F.col("b")), months_between_starts(F.col("b"), F.col("a"))
    ).first()
    assert tuple(row) == (14, -14)


def test_quality(prepared):
    checks = prepared[1]
    assert checks["fact_rows_minus_item_rows"]["passed"] and checks["lost_zips"]["passed"]
    assert (checks["distance_share"]["observed"], checks["distance_share"]["passed"]) == (0.6, False)
    assert (checks["late_share"]["observed"], checks["late_share"]["passed"]) == (0.4, True)
    assert checks["unknown_statuses"]["passed"]
    assert checks["pickup_before_approval"]["observed"] == 1.0


def test_quality_failures(spark, shop, shop_orders, raw):
    doubled = shop.unionAll(shop).withColumn("order_status", F.lit("lost"))
    changed = shop_orders.unionAll(shop_orders.withColumn("customer_city", F.lit("elsewhere")))
    zips = etl.geo_centroids(raw["geolocation"]).limit(1)
    rows = quality.quality_checks(
        doubled, raw["order_items"], raw["geolocation"], zips, changed, min_distance_share=0.1, late_share=(0.5, 1.0)
    )
    checks = {r["check"]: (r["observed"], r["passed"]) for r in rows.collect()}
    assert checks["fact_rows_minus_item_rows"] == (5.0, False)
    assert checks["lost_zips"][0] > 0 and not checks["lost_zips"][1]
    assert checks["duplicate_orders"] == (4.0, False)
    assert checks["late_share"] == (0.4, False)
    assert checks["unknown_statuses"] == (1.0, False)
    assert [r[0] for r in quality.unknown_statuses(doubled).collect()] == ["lost"]
    with pytest.raises(job.QualityError, match="late_share"):
        job.require(rows)


def test_quality_of_an_empty_fact(shop, shop_orders, raw):
    none, places = raw["order_items"].limit(0), raw["geolocation"]
    rows = quality.quality_checks(shop.limit(0), none, places, etl.geo_centroids(places), shop_orders.limit(0))
    checks = {r["check"]: (r["observed"], r["passed"]) for r in rows.collect()}
    assert checks["fact_rows_minus_item_rows"] == (0.0, True)
    assert checks["distance_share"] == (None, False)


def test_the_job_writes_every_table(spark, prepared):
    from marketlens.plans.slices import SLICES
    from marketlens.sources.tables import table_names

    expected = {*RAW_SCHEMAS, "geo_centroids", "orders_enriched", "agg_order", *SLICES,
                "dim_customer", "agg_customer_day", "agg_customer", "agg_state_monthly", "agg_category", "agg_seller"}
    assert set(table_names(spark, prepared[0])) == expected


def test_rollups(spark, prepared):
    category = {r["category"]: r for r in spark.read.parquet(f"{prepared[0]}/agg_category.parquet").collect()}
    assert set(category) == {"books", "furniture"}  # items without a category are left out
    assert (category["books"]["order_count"], category["books"]["gmv"]) == (2, 249.5)
    assert category["books"]["late_rate"] == 0.5
    seller = {r["seller_id"]: r for r in spark.read.parquet(f"{prepared[0]}/agg_seller.parquet").collect()}
    assert (seller["s2"]["seller_lat"], seller["s2"]["order_count"], seller["s2"]["category_count"]) == (None, 2, 1)
    state = spark.read.parquet(f"{prepared[0]}/agg_state_monthly.parquet")
    september = state.where("customer_state = 'SP' AND order_year_month = DATE '2018-09-01'").first()
    assert (september["order_count"], september["unique_customers"], september["avg_delay_days"]) == (2, 2, None)
