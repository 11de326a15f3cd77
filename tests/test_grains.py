"""Pages give the same on the fact and on its order rollup."""

from __future__ import annotations

import os
from datetime import date

import pytest

from checks.compare import normalized
from checks.testdata import fact, order_rollup
from marketlens.operators.filters import ALL_ROWS, FilterSpec, apply_filters, coarsest
from marketlens.plans import cohorts, delivery, funnel, geo, overview, payments, rollups

SF = "/root/testdata/sf0.001"
SPECS = {
    "all": ALL_ROWS,
    "dates": FilterSpec(date_from=date(1996, 2, 10), date_to=date(1999, 8, 5)),
    "states": FilterSpec.of({"states": ["SP", "RJ", "AC"], "statuses": ["delivered", "canceled"]}),
}
PAGES = {
    "kpis": overview.kpis,
    "monthly": overview.monthly_orders,
    "top states": overview.top_states,
    "states": geo.state_metrics,
    "ranked states": geo.ranked_states,
    "cities": lambda df, spec: geo.city_drilldown(df, spec, "SP"),
    "delivery": delivery.kpis,
    "delays": delivery.delay_by_state,
    "stages": delivery.stage_breakdown_long,
    "histogram": delivery.delay_histogram,
    "delay medians": delivery.delay_medians,
    "payments": payments.kpis,
    "instalments": payments.installments_monthly,
    "instalment orders": payments.installment_orders,
    "boxes": payments.installment_box,
    "types": payments.type_summary,
    "buckets": payments.bucket_summary,
    "retention": cohorts.retention,
    "repeat": cohorts.repeat_kpis,
    "funnel": funnel.order_funnel,
    "status": funnel.status_breakdown,
    "stage medians": funnel.stage_medians,
    "rollup": lambda df, spec: rollups.state_monthly(apply_filters(df, spec)),
}


def same(left, right):
    assert left.columns == right.columns
    a, b = (normalized(df.columns, map(tuple, df.collect())) for df in (left, right))
    assert a == b


@pytest.mark.parametrize("page", sorted(PAGES))
def test_shop(shop, shop_orders, page):
    same(PAGES[page](shop, ALL_ROWS), PAGES[page](shop_orders, ALL_ROWS))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("spec", sorted(SPECS))
@pytest.mark.parametrize("page", sorted(PAGES))
def test_supplied_tables(spark, page, spec):
    run = PAGES[page]
    same(run(fact(spark, SF), SPECS[spec]), run(order_rollup(spark, SF), SPECS[spec]))


def test_rollup_keeps_every_item(shop, shop_orders):
    rollup = shop_orders
    assert rollup.count() == shop.select("order_id").distinct().count()
    totals = rollup.selectExpr("sum(items) AS n", "sum(order_value) AS v").first()
    assert tuple(totals) == (5, 1425.0)


@pytest.mark.parametrize("condition", [{"categories": ["books"]}, {"seller_states": ["SP"]}, {"min_value": 1.0}])
def test_conditions_on_items_need_the_fact(shop, shop_orders, condition):
    rollup, spec = shop_orders, FilterSpec.of(condition)
    assert coarsest(shop, rollup, spec) is shop
    with pytest.raises(ValueError, match="need the fact"):
        overview.kpis(rollup, spec)
    assert coarsest(shop, rollup, FilterSpec()) is rollup


def test_value_tiers_need_the_fact(shop_orders):
    with pytest.raises(Exception, match="total_item_value"):
        payments.mix(shop_orders, ALL_ROWS)


def test_counting_orders_of_the_rollup_reads_no_ids(spark, prepared):
    rollup = spark.read.parquet(f"{prepared[0]}/agg_order.parquet")
    plan = overview.kpis(rollup, ALL_ROWS)._jdf.queryExecution().executedPlan().toString()
    assert "order_id" not in plan
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan


def test_only_ids_and_sums_of_the_items_travel(spark, shop, shop_orders):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rollups.by_order(shop, shop_orders)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "partial_count" in line]
    assert shuffled and all("keys=[order_id" in line and "customer" not in line for line in shuffled)
