"""What the physical plans must and must not do."""

from __future__ import annotations

import os
import re
from datetime import date
from pathlib import Path

import pytest

from checks.catalog import QUERIES
from marketlens.operators.filters import ALL_ROWS, FilterSpec, apply_filters
from marketlens.plans import etl, geo, job, overview, sellers
from marketlens.session import shared_dir
from marketlens.sources import tables

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark, shop):
    spec = FilterSpec.of(
        {"date_from": date(2017, 1, 1), "states": ["SP"], "min_value": 10.0, "statuses": ["delivered", "shipped"]}
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(overview.top_states(shop, spec))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for condition in ("GreaterThanOrEqual(order_purchase_timestamp", "customer_state", "total_item_value", "order_status"):
        assert condition in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "seller_id" not in schema and "product_id" not in schema


def test_months_outside_the_dates_are_not_read(spark, shop, tmp_path):
    stored = tables.write_fact(shop, str(tmp_path / "fact"))
    spec = FilterSpec.of({"date_from": date(2017, 2, 10), "date_to": date(2018, 1, 5)})
    plan = plan_of(apply_filters(stored, spec))
    assert "PartitionFilters: [isnotnull(order_year_month" in plan
    assert apply_filters(stored, spec).select("order_id").collect() == [("o2",)]


def test_top_k_does_not_sort_everything(shop):
    assert "TakeOrderedAndProject" in plan_of(overview.top_states(shop, ALL_ROWS))
    assert "TakeOrderedAndProject" in plan_of(geo.ranked_cities(shop, ALL_ROWS, "SP"))


def test_one_seller_is_a_scan_filter(shop):
    assert "EqualTo(seller_id,s1)" in plan_of(sellers.spotlight(shop, "s1", ALL_ROWS))


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_the_engine_or_multiplies_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert forbidden not in plan


@pytest.fixture
def small_splits(spark):
    """Sort-merge joins only, and limits low enough for a test to meet."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("hot", ["order", "seller", "product"])
def test_a_hot_key_is_split_and_no_row_is_lost(spark, shop_csv, tmp_path, small_splits, hot):
    from marketlens.sources.raw import read_raw

    n = 30_000
    raw = dict(read_raw(spark, shop_csv))
    key = {
        "order_id": "if(id % 3 = 0, 'o1', concat('o', id))" if hot == "order" else "concat('o', id)",
        "seller_id": "if(id % 3 = 0, 's1', concat('s', id))" if hot == "seller" else "concat('s', id)",
        "product_id": "if(id % 3 = 0, 'p1', concat('p', id))" if hot == "product" else "concat('p', id)",
    }
    # Eight input tasks, so that the hot partition has several blocks to split at.
    items = spark.range(0, n, 1, 8).selectExpr(
        f"{key['order_id']} AS order_id", "cast(id AS int) AS order_item_id", f"{key['product_id']} AS product_id",
        f"{key['seller_id']} AS seller_id", "TIMESTAMP_NTZ '2018-01-01' AS shipping_limit_date",
        "cast(id AS double) AS price", "1.0D AS freight_value",
    )
    ids = spark.range(0, n)
    raw["order_items"] = items
    raw["orders"] = ids.selectExpr(
        "concat('o', id) AS order_id", "concat('c', id) AS customer_id", "'shipped' AS order_status",
        "TIMESTAMP_NTZ '2018-01-01' AS order_purchase_timestamp",
        *[f"CAST(NULL AS timestamp_ntz) AS {c}" for c in etl.ORDER_COLUMNS if c.endswith(("_at", "_date"))],
    )
    raw["customers"] = ids.selectExpr(
        "concat('c', id) AS customer_id", "concat('u', id) AS customer_unique_id",
        "'01046' AS customer_zip_code_prefix", "'x' AS customer_city", "'SP' AS customer_state",
    )
    raw["sellers"] = ids.selectExpr(
        "concat('s', id) AS seller_id", "'01046' AS seller_zip_code_prefix", "'x' AS seller_city", "'SP' AS seller_state"
    )
    raw["products"] = ids.selectExpr(
        "concat('p', id) AS product_id", "'livros' AS product_category_name", "1.0D AS product_weight_g"
    )
    path = str(tmp_path / "centroids")
    etl.geo_centroids(raw["geolocation"]).write.parquet(path)
    centroids, side = spark.read.parquet(path), str(tmp_path / "side")
    etl.order_side(raw, centroids).write.parquet(side)
    joined = etl.balanced_fact(raw, centroids, spark.read.parquet(side))
    fact = joined.select("order_id", "price", "seller_city", "product_category_name")
    plan = final_plan_of(fact)
    assert re.search(rf"SortMergeJoin\(skew=true\) \[{hot}_id#", plan)
    totals = fact.selectExpr("count(*) AS n", "sum(price) AS total").first()
    assert (totals["n"], totals["total"]) == (n, n * (n - 1) / 2)


def test_the_prepared_fact_is_pruned_by_month(spark, prepared):
    fact = spark.read.parquet(f"{prepared[0]}/orders_enriched.parquet")
    spec = FilterSpec.of({"date_from": date(2017, 2, 10), "date_to": date(2018, 1, 5)})
    kept = apply_filters(fact, spec)
    assert "PartitionFilters: [isnotnull(order_year_month" in plan_of(kept)
    files = {row["f"] for row in kept.selectExpr("input_file_name() AS f").collect()}
    assert all("order_year_month=2017-03-01" in file for file in files)


def test_one_seller_skips_row_groups(spark, tmp_path):
    from marketlens.sources.tables import write_fact

    rows = spark.range(0, 400_000, 1, 4).selectExpr(
        "concat('s', lpad(id * 7919 % 1000, 4, '0')) AS seller_id", "id", "DATE '2018-01-01' AS order_year_month"
    )
    path = str(tmp_path / "sorted")
    write_fact(tables.balanced(rows), path, "seller_id")
    for file in (tmp_path / "sorted").rglob("part-*.parquet"):
        import pyarrow.parquet as pq

        ids = pq.read_table(file).column("seller_id").to_pylist()
        assert ids == sorted(ids)


def test_missing_zips_are_spread(spark):
    rows = spark.range(5000).selectExpr("concat('s', id) AS seller_id", "IF(id % 5 = 0, '01046', CAST(NULL AS string)) AS zip")
    places = spark.createDataFrame([("01046", 1.0, 2.0), (None, 3.0, 4.0)], "zip string, lat double, lng double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = etl._located(rows, "zip", places, "seller", "seller_id")
        sizes = [n for n in found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()]
        assert found.where("seller_lat = 1.0").count() == 1000 and sum(sizes) == 5000
        assert sum(n > 500 for n in sizes) > 1  # without zip: not all in one partition
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


WRITES_FIRST = {"ingest_orders", "ingest_customers", "ingest_reviews", "ingest_parquet", "state_boundaries"}


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES_FIRST))
def test_building_a_plan_writes_nothing(spark, name):
    QUERIES[name](spark, SF)  # builds the stored tables on their first use
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = sorted(folder.rglob("_SUCCESS"))
    QUERIES[name](spark, SF)
    assert sorted(folder.rglob("_SUCCESS")) == before


def test_the_job_leaves_nothing_staged(spark, shop_csv, tmp_path):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = sorted(folder.rglob("_SUCCESS"))
    job.prepare(spark, shop_csv, str(tmp_path))
    assert sorted(folder.rglob("_SUCCESS")) == before
