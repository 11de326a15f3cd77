"""Headline figures of the filtered fact."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.functions.measures import grain_of
from marketlens.functions.timing import month_start
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.ranking import largest


def kpis(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    m = grain_of(fact)
    return apply_filters(fact, spec).agg(
        m.orders().alias("total_orders"),
        m.gmv().alias("total_gmv"),
        m.review().alias("avg_review_score"),
        m.late_pct().alias("late_delivery_pct"),
    )


def monthly_orders(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    month = month_start("order_purchase_timestamp").alias("month")
    counted = apply_filters(fact, spec).groupBy(month).agg(grain_of(fact).orders().alias("orders"))
    return counted.orderBy("month")


def top_states(fact: DataFrame, spec: FilterSpec = FilterSpec(), n: int = 5) -> DataFrame:
    by_state = apply_filters(fact, spec).groupBy("customer_state").agg(grain_of(fact).gmv().alias("gmv"))
    return largest(by_state, n, "gmv", ["customer_state"])
