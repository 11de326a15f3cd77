"""Report pages on the hand-made shop: missing values, ties, empty results."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from marketlens.functions import classes
from marketlens.operators.filters import ALL_ROWS, FilterSpec
from marketlens.plans import (
    category,
    cohorts,
    delivery,
    flow,
    funnel,
    geo,
    marks,
    overview,
    payments,
    reviews,
    sellers,
)

NOTHING = FilterSpec.of({"states": ["??"]})


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_overview(shop):
    row = overview.kpis(shop, ALL_ROWS).first()
    assert (row["total_orders"], row["total_gmv"]) == (4, 50.0 + 1020.0 + 5.5 + 150.0 + 199.5)
    assert row["late_delivery_pct"] == 40.0  # items, undelivered ones included
    assert row["avg_review_score"] == (2.5 + 2.5 + 5 + 3) / 4  # items with a review
    months = [(r["month"], r["orders"]) for r in overview.monthly_orders(shop, ALL_ROWS).collect()]
    assert months == [(date(2017, 1, 1), 1), (date(2017, 3, 1), 1), (date(2018, 9, 1), 2)]
    assert [r["customer_state"] for r in overview.top_states(shop, ALL_ROWS, 1).collect()] == ["SP"]


def test_default_dates_apply(shop):
    assert overview.kpis(shop).first()["total_orders"] == 3


@pytest.mark.parametrize(
    "page", [overview.kpis, delivery.kpis, category.kpis, sellers.kpis, payments.kpis, flow.kpis, cohorts.repeat_kpis]
)
def test_figures_of_nothing(shop, page):
    (row,) = page(shop, NOTHING).collect()
    assert all(value in (None, 0) for value in row)


@pytest.mark.parametrize(
    "page",
    [
        overview.monthly_orders, overview.top_states, geo.state_metrics, geo.ranked_states, flow.routes, flow.matrix,
        flow.top_routes, delivery.delay_by_state, delivery.stage_breakdown_long, delivery.delay_histogram,
        category.flags, category.quadrants, category.worst5, sellers.leaderboard, sellers.quadrants, sellers.top5,
        payments.mix, payments.installments_monthly, payments.installment_box, payments.type_summary,
        payments.bucket_summary, cohorts.retention, reviews.driver_rows, reviews.driver_medians, reviews.driver_boxes,
        reviews.driver_top3, reviews.driver_summary, funnel.status_breakdown, funnel.stage_medians,
    ],
)
def test_tables_of_nothing(shop, page):
    assert page(shop, NOTHING).collect() == []


def test_states_and_cities(shop):
    state = rows(geo.state_metrics(shop, ALL_ROWS), "customer_state")
    assert (state["SP"]["order_count"], state["SP"]["unique_customers"]) == (3, 3)
    assert state["SP"]["lat"] == -23.625  # the customer without a position does not count
    cities = geo.city_drilldown(shop, ALL_ROWS, "SP", "gmv").collect()
    assert [(r["customer_city"], r["gmv"]) for r in cities] == [("sao paulo", 1269.5), ("nowhere", 150.0)]
    top = geo.ranked_cities(shop, ALL_ROWS, "SP", "avg_review_score").collect()
    assert [r["customer_city"] for r in top] == ["sao paulo"]  # no review in the other
    with pytest.raises(ValueError, match="metric"):
        geo.city_drilldown(shop, ALL_ROWS, "SP", "gmv DESC; --")


def test_city_extent(spark, shop):
    row = geo.city_extent(shop, ALL_ROWS, "SP").first()
    assert (row["center_lat"], row["lat_span"], row["span"]) == (-23.625, 0.0, 0.5)


def test_flows(spark, shop):
    routes = rows(flow.routes(shop, ALL_ROWS, 1), "seller_state", "customer_state")
    assert {key: r["order_count"] for key, r in routes.items()} == {("RJ", "SP"): 2, ("PE", "SP"): 2, ("RJ", "RJ"): 1}
    assert flow.routes(shop, ALL_ROWS, 2).count() == 2
    kpis = flow.kpis(shop, ALL_ROWS, 1).first()
    assert tuple(kpis) == (2, 1425.0, "RJ", "SP")
    top = flow.top_routes(shop, ALL_ROWS, 1).collect()
    assert [r["seller_state"] for r in top] == ["PE", "RJ"]  # a tie goes by state
    labels = [tuple(r) for r in flow.route_labels(flow.top_routes(shop, ALL_ROWS, 1)).collect()]
    assert labels[0] == ("PE", "SP", 2, "R$ 1,170", "1.5", "N/A")
    wide = rows(flow.matrix_wide(flow.matrix(shop, ALL_ROWS), ["RJ", "SP"]), "seller_state")
    assert (wide["PE"]["SP"], wide["PE"]["RJ"]) == (2, 0)


def test_unknown_states_in_flows(shop):
    unknown = shop.withColumn("seller_state", F.when(F.col("seller_state") == "RJ", F.lit("RJ")))
    kpis = flow.kpis(unknown, ALL_ROWS, 1).first()
    assert (kpis["cross_state_routes"], kpis["top_seller_state"]) == (2, "RJ")  # unknown differs from SP
    assert {r["seller_state"] for r in flow.matrix(unknown, ALL_ROWS).collect()} == {"RJ"}
    tied = flow.kpis(shop.where("order_id = 'o1'"), ALL_ROWS, 1).first()
    assert tied["top_seller_state"] == "PE"


def test_delivery(shop):
    row = delivery.kpis(shop, ALL_ROWS).first()
    assert (row["late_delivery_pct"], row["on_time_pct"], row["avg_delay_when_late"]) == (40.0, 60.0, 1.5)
    bins = [tuple(r) for r in delivery.delay_histogram(shop, ALL_ROWS).collect()]
    assert bins == [(0, "Early / On Time", 1), (1, "Late", 2)]
    assert tuple(delivery.delay_medians(shop, ALL_ROWS).first()) == (2, 1, 1.5, 0.0)
    assert [r["customer_state"] for r in delivery.delay_summary(shop, ALL_ROWS).collect()] == ["SP", "RJ"]
    long = rows(delivery.stage_breakdown_long(shop, ALL_ROWS), "customer_state", "stage")
    assert long["RJ", "Approval → Carrier"]["days"] == -0.5
    assert len(long) == 6


def test_delay_medians_without_late_items(shop):
    row = delivery.delay_medians(shop.where("order_id = 'o2'"), ALL_ROWS).first()
    assert tuple(row) == (0, 1, None, 0.0)


def test_categories(shop):
    found = rows(category.flags(shop, ALL_ROWS), "category")
    assert set(found) == {"books", "furniture", "Unknown"}
    assert found["Unknown"]["order_count"] == 2
    assert (found["books"]["late_flag"], found["books"]["review_flag"]) == ("red", "red")
    assert (found["Unknown"]["review_flag"], found["Unknown"]["freight_flag"]) == ("green", "red")
    assert category.kpis(shop, ALL_ROWS).first()["avg_late_pct"] == 50.0  # each category once
    assert [r["category"] for r in category.worst5(shop, ALL_ROWS, 1).collect()] == ["furniture", "books", "Unknown"]
    quadrant = rows(category.quadrants(shop, ALL_ROWS), "category")
    assert quadrant["books"]["quadrant"] == "problem" and quadrant["Unknown"]["quadrant"] == "high quality"


def test_limits_of_flags(spark):
    df = spark.createDataFrame(
        [(4.0, 10.0, 0.3), (3.0, 10.5, 0.31), (2.99, 0.0, 0.0), (None, None, None)],
        "avg_review_score double, late_pct double, avg_freight_ratio double",
    )
    flags = df.select(classes.review_flag(), classes.late_flag(), classes.freight_flag())
    assert [tuple(r) for r in flags.collect()] == [
        ("green", None, None), ("yellow", "red", "red"), ("red", None, None), (None, None, None),
    ]


def test_sellers(shop):
    board = sellers.leaderboard(shop, ALL_ROWS, 1).collect()
    assert [(r["seller_id"], r["order_count"], r["category_count"]) for r in board] == [("s2", 2, 1), ("s1", 3, 1)]
    assert sellers.leaderboard(shop, ALL_ROWS, 3).count() == 1
    spot = sellers.spotlight(shop, "s1", ALL_ROWS, 1).first()
    assert (spot["orders_label"], spot["gmv_label"], spot["late_label"]) == ("3", "R$ 255", "33.3%")
    assert sellers.worst5(shop, ALL_ROWS, 1, 1).first()["seller"] == "s2…"
    assert sellers.worst5(shop, ALL_ROWS, 1, 50).count() == 0
    shown = sellers.display(shop, ALL_ROWS, 1).collect()
    assert [r["city"] for r in shown] == ["Recife", "Santa Barbara D'Oeste"]


def test_payments(shop):
    row = payments.kpis(shop, ALL_ROWS).first()
    assert (row["cc_pct"], row["boleto_pct"]) == (50.0, 25.0)  # of items with a known type
    assert row["avg_installments"] == (13 + 13 + 1) / 3
    mix = rows(payments.mix(shop, ALL_ROWS), "value_tier", "primary_payment_type")
    assert mix["50–200", "credit_card"]["pct"] == 50.0
    assert mix["1000+", "credit_card"]["pct"] == 100.0
    assert mix["<50", "coupon"]["payment_label"] is None
    tiers = [r["value_tier"] for r in payments.mix(shop, ALL_ROWS).collect()]
    assert tiers == ["<50", "50–200", "50–200", "1000+"]
    summary = rows(payments.bucket_summary(shop, ALL_ROWS), "installment_bucket")
    assert set(summary) == {"1", "12+"}  # zero and missing are left out
    assert [tuple(r) for r in payments.installment_orders(shop, ALL_ROWS).collect()] == [("12+", 2.5)]


def test_class_limits(spark):
    values = spark.createDataFrame([(49.99,), (50.0,), (200.0,), (500.0,), (1000.0,), (None,)], "total_item_value double")
    tiers = [r[0] for r in values.select(classes.value_tier()).collect()]
    assert tiers == ["<50", "50–200", "200–500", "500–1000", "1000+", "1000+"]
    counts = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,), (7,), (12,), (13,)], "n int")
    buckets = [r[0] for r in counts.select(classes.installment_bucket("n")).collect()]
    assert buckets == ["1", "2–3", "2–3", "4–6", "4–6", "7–12", "7–12", "12+"]


def test_cohorts(shop):
    long = rows(cohorts.retention(shop, ALL_ROWS), "cohort_month", "months_since_first")
    january = date(2017, 1, 1)
    assert long[january, 0]["cohort_size"] == 1 and long[january, 2]["retention_pct"] == 100.0  # u1 came back
    assert long[date(2018, 9, 1), 0]["active_customers"] == 2
    wide = rows(cohorts.retention_wide(cohorts.retention(shop, ALL_ROWS), [0, 2]), "cohort_month")
    assert wide[january]["2"] == 100.0 and wide[date(2018, 9, 1)]["2"] is None


def test_dates_choose_the_cohort_but_not_the_activity(shop):
    spec = FilterSpec.of({"date_from": date(2017, 2, 1), "date_to": date(2017, 12, 31)})
    long = rows(cohorts.retention(shop, spec), "cohort_month", "months_since_first")
    march = date(2017, 3, 1)
    assert set(long) == {(march, -2), (march, 0)}


def test_repeat(shop):
    row = cohorts.repeat_kpis(shop, ALL_ROWS).first()
    assert tuple(row)[:2] == (3, 1)
    assert row["repeat_rate_pct"] == pytest.approx(100 / 3) and row["avg_orders_returning"] == 2.0


def test_reviews(shop):
    medians = rows(reviews.driver_medians(shop, ALL_ROWS), "score_bucket")
    assert medians["Negative (1–2)"]["median_delay_days"] == 1.5
    assert medians["Neutral (3)"]["median_delay_days"] is None and medians["Neutral (3)"]["n"] == 1
    summary = rows(reviews.driver_summary(shop, ALL_ROWS), "score_bucket")
    assert summary["Negative (1–2)"]["top_categories"] == "books, furniture"
    assert summary["Positive (4–5)"]["top_states"] == "RJ"


def test_funnel(shop):
    row = funnel.order_funnel(shop, ALL_ROWS).first()
    assert tuple(row) == (4, 2, 3, 2)
    stages = [tuple(r) for r in funnel.funnel_stages(funnel.order_funnel(shop, ALL_ROWS)).collect()]
    assert stages == [("placed", 4), ("approved", 2), ("carrier_pickup", 3), ("delivered", 2)]
    status = rows(funnel.status_breakdown(shop, ALL_ROWS), "order_status")
    assert status["delivered"]["pct"] == 50.0
    hours = rows(funnel.stage_medians(shop, ALL_ROWS), "order_status")
    assert hours["delivered"]["median_approval_hours"] == 2.0
    assert hours["processing"]["median_transit_hours"] is None


def test_marks(shop):
    bubbles = rows(marks.state_bubbles(geo.state_metrics(shop, ALL_ROWS), "gmv"), "customer_state")
    assert (bubbles["RJ"]["radius"], bubbles["SP"]["radius"]) == (90_000.0, 280_000.0)
    assert bubbles["SP"]["label"] == "R$ 1,420" and bubbles["SP"]["state_name"] == "São Paulo"
    score = rows(marks.state_bubbles(geo.state_metrics(shop, ALL_ROWS), "avg_review_score"), "customer_state")
    assert score["RJ"]["label"] == "5.00"
    arcs = marks.flow_arcs(flow.routes(shop, ALL_ROWS, 1), "avg_delay_days").collect()
    assert [(r["seller_state"], r["width"], r["color_position"]) for r in arcs] == [("RJ", 2.0, 0.0)]
    points = marks.seller_points(sellers.leaderboard(shop, ALL_ROWS, 1)).collect()
    assert [(r["short_id"], r["radius"]) for r in points] == [("s1…", 12_000.0)]  # only one is located
    delays = rows(marks.delay_points(delivery.delay_by_state(shop, ALL_ROWS)), "customer_state")
    assert (delays["SP"]["color_position"], delays["SP"]["delay_label"]) == (1.0, "+1.5")
    assert (delays["RJ"]["color_position"], delays["RJ"]["radius"]) == (0.0, 80_000.0)
