"""The stored rollups by seller, category and route give what distinct counts on the fact give."""

from __future__ import annotations

import os
from datetime import date
from itertools import product

import pytest
from pyspark.sql import functions as F

from checks.compare import normalized
from checks.testdata import fact, table
from marketlens.operators.filters import ALL_ROWS, FACT, FilterSpec, apply_filters, pick
from marketlens.plans import category, flow, rollups, sellers
from marketlens.plans.slices import SLICES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CHOICES = {
    "date_from": date(1996, 2, 10),
    "date_to": date(1999, 8, 5),
    "states": ["SP", "RJ", "MG", "BA", "AC"],
    "categories": ["economy_1_en", "large_2_en", "promo_3_en", "standard_0_en"],
    "statuses": ["delivered", "shipped"],
    "min_value": 100.5,
}
SELLERS = ("seller_id", "seller_city", "seller_state")
CATEGORIES = ("product_category_name_english",)
ROUTES = ("seller_state",)


def sellers_by_distinct(items):
    return items.groupBy(*SELLERS).agg(
        F.expr("count(DISTINCT order_id)").alias("order_count"), F.sum("total_item_value").alias("gmv"),
        F.avg("seller_lat").alias("seller_lat"), F.avg("seller_lng").alias("seller_lng"), F.avg("avg_review_score").alias("avg_review_score"),
        F.expr("count_if(is_late) * 100.0D / count(*)").alias("late_pct"), F.avg("approval_wait_hours").alias("avg_approval_wait_hours"),
        F.expr("count(DISTINCT product_category_name_english)").alias("category_count"),
    )


def categories_by_distinct(items):
    name = F.coalesce("product_category_name_english", F.lit("Unknown")).alias("category")
    return items.groupBy(name).agg(
        F.expr("count(DISTINCT order_id)").alias("order_count"), F.sum("total_item_value").alias("gmv"),
        F.avg("price").alias("avg_price"), F.avg("freight_ratio").alias("avg_freight_ratio"), F.avg("avg_review_score").alias("avg_review_score"),
        F.expr("count_if(is_late) * 100.0D / count(*)").alias("late_pct"), F.avg("transit_days").alias("avg_transit_days"),
    )


def routes_by_distinct(items):
    means = {c: F.avg(c).alias(c) for c in ("seller_lat", "seller_lng", "customer_lat", "customer_lng")}
    return items.groupBy("seller_state", "customer_state").agg(
        F.expr("count(DISTINCT order_id)").alias("order_count"), F.sum("total_item_value").alias("gmv"), *means.values(),
        F.avg("delay_days").alias("avg_delay_days"), F.avg("seller_customer_distance_km").alias("avg_distance_km"),
    )


PAGES = {
    "sellers": (lambda df, spec: sellers.leaderboard(df, spec, 1), sellers_by_distinct, SELLERS),
    "categories": (category.scorecard, categories_by_distinct, CATEGORIES),
    "routes": (lambda df, spec: flow.routes(df, spec, 1), routes_by_distinct, ROUTES),
}


def values(df):
    """Distances are sums of roots, whose last bits depend on the order of work."""
    if "avg_distance_km" in df.columns:
        df = df.withColumn("avg_distance_km", F.round("avg_distance_km", 3))
    return normalized(df.columns, map(tuple, df.collect()))


@needs_data
@pytest.mark.parametrize("on", list(product([False, True], repeat=len(CHOICES))))
def test_all_filters(spark, on):
    spec = FilterSpec.of({key: CHOICES[key] for key, wanted in zip(CHOICES, on) if wanted})
    for page, by_distinct, groups in PAGES.values():
        name = pick(spec, *groups)
        assert (name == FACT) == (bool(spec.min_value) or bool(spec.categories) and groups != CATEGORIES)
        assert values(page(table(spark, SF, name), spec)) == values(by_distinct(apply_filters(fact(spark, SF), spec)))


@needs_data
@pytest.mark.parametrize("page", sorted(PAGES))
def test_seller_states(spark, page):
    spec = FilterSpec.of({"seller_states": ["SP", "PR", "RS"], "statuses": ["delivered"]})
    run, by_distinct, groups = PAGES[page]
    assert values(run(table(spark, SF, pick(spec, *groups)), spec)) == values(by_distinct(apply_filters(fact(spark, SF), spec)))


def test_what_is_picked():
    assert pick(ALL_ROWS) == "agg_order" and pick(ALL_ROWS, *ROUTES) == "agg_order_route"
    assert pick(ALL_ROWS, *CATEGORIES) == "agg_order_category" and pick(ALL_ROWS, *SELLERS) == "agg_order_seller"
    assert pick(ALL_ROWS, "seller_id", "product_category_name_english") == FACT
    picked = FilterSpec.of({"seller_states": ["SP"]})
    assert pick(picked) == pick(picked, *CATEGORIES) == FACT  # an order may meet it in two rows
    assert pick(picked, *ROUTES) == "agg_order_route" and pick(picked, *SELLERS) == "agg_order_seller"
    assert pick(FilterSpec.of({"min_value": 1.0}), *SELLERS) == FACT
    assert pick(FilterSpec.of({"states": ["SP"], "min_value": 0}), *SELLERS) == "agg_order_seller"


def test_slices_of_the_shop(spark, shop, prepared):
    """The job stores them; a slice keeps every item, its values and each order once a group."""
    for name, make in SLICES.items():
        stored = spark.read.parquet(f"{prepared[0]}/{name}.parquet")
        assert stored.columns == make(shop).columns and values(stored) == values(make(shop))
        assert tuple(stored.selectExpr("sum(items)", "sum(order_value)").first()) == (5, 1425.0)
    for stored, by_page in ((rollups.by_seller, "agg_order_seller"), (rollups.by_category, "agg_order_category")):
        assert values(stored(shop)) == values(stored(spark.read.parquet(f"{prepared[0]}/{by_page}.parquet")))
    with pytest.raises(ValueError, match="need the fact"):
        apply_filters(SLICES["agg_order_route"](shop), FilterSpec.of({"categories": ["books"]}))


def test_an_order_counts_once_a_seller(spark, shop):
    """Three items in two categories with one seller, and a missing category, are one order and one or two categories."""
    one = shop.where("order_id = 'o1'").limit(1)
    rows = one.drop("product_category_name_english", "order_item_id").crossJoin(
        spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b")], "order_item_id int, product_category_name_english string")
    )
    row = sellers.leaderboard(rows, ALL_ROWS, 1).first()
    assert (row["order_count"], row["category_count"]) == (1, 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SELLER_PAGES = [sellers.leaderboard, sellers.kpis, sellers.quadrants, sellers.display, sellers.top5, sellers.worst5]


@pytest.mark.parametrize("page", SELLER_PAGES)
def test_no_expand_in_seller_plans(spark, shop, prepared, page):
    stored = spark.read.parquet(f"{prepared[0]}/agg_order_seller.parquet")
    assert "Expand" not in plan_of(page(shop, ALL_ROWS)) and "Expand" not in plan_of(page(stored, ALL_ROWS))
    assert "order_id" not in plan_of(page(stored, ALL_ROWS))


def test_other_pages_shuffle_no_ids(spark, prepared):
    routes = spark.read.parquet(f"{prepared[0]}/agg_order_route.parquet")
    categories = spark.read.parquet(f"{prepared[0]}/agg_order_category.parquet")
    for plan in (flow.routes(routes, ALL_ROWS), flow.matrix(routes, ALL_ROWS), category.top5(categories, ALL_ROWS), rollups.by_category(categories)):
        assert "order_id" not in plan_of(plan) and "Expand" not in plan_of(plan)
    assert "PartitionFilters: [isnotnull(order_year_month" in plan_of(flow.routes(routes, FilterSpec()))
