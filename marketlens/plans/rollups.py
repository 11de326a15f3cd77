"""Unfiltered rollups of the fact, stored beside it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import ITEMS, ORDER_VALUE, grain_of, weighed
from marketlens.operators.filters import ALL_ROWS
from marketlens.plans.customers import with_customers
from marketlens.plans.slices import (
    CATEGORY,
    PLACE,
    SELLER,
    late_share,
    order_category,
    order_seller,
    seller_figures,
    sliced,
)

# What an order fixes for all its items.
ORDER_ATTRIBUTES = [
    "customer_id",
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "customer_lat",
    "customer_lng",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "avg_review_score",
    "min_review_score",
    "review_count",
    "total_payment",
    "max_installments",
    "primary_payment_type",
    "approval_wait_hours",
    "carrier_wait_hours",
    "transit_days",
    "delay_days",
    "is_late",
    "order_year_month",
]


def by_order(fact: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order with its attributes, item count and value.

    Most pages look at nothing finer. On this rollup they count orders without
    shuffling order ids, which is most of their cost on the fact. Only the id and two
    numbers of the items travel; the attributes come from ``orders`` (``etl.order_measures``).
    """
    count, total = weighed(fact)
    sums = fact.groupBy("order_id").agg(count(F.lit(1)).alias(ITEMS), total("total_item_value").alias(ORDER_VALUE))
    return orders.select("order_id", *ORDER_ATTRIBUTES).join(sums, "order_id")


def state_monthly(fact: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """From the fact or its order rollup; customers from the stored bitmaps ``days``, if given."""
    m, keys = grain_of(fact), ("customer_state", "order_year_month")
    figures = fact.groupBy(*keys).agg(
        m.orders().alias("order_count"),
        *([m.customers().alias("unique_customers")] if days is None else []),
        m.gmv().alias("gmv"),
        m.mean("delay_days").alias("avg_delay_days"),
        m.late_rate().alias("late_rate"),
        m.review().alias("avg_review_score"),
    )
    return figures if days is None else with_customers(figures, days, ALL_ROWS, *keys)


def by_category(fact: DataFrame) -> DataFrame:
    """From the fact or ``agg_order_category``; items without an English category are left out."""
    rows = sliced(fact.where(F.col(CATEGORY).isNotNull()), order_category)
    m = grain_of(rows)
    return rows.groupBy(F.col(CATEGORY).alias("category")).agg(
        m.orders().alias("order_count"),
        m.gmv().alias("gmv"),
        m.mean("price").alias("avg_price"),
        m.mean("freight_ratio").alias("avg_freight_ratio"),
        m.review().alias("avg_review_score"),
        m.late_rate().alias("late_rate"),
        m.mean("transit_days").alias("avg_transit_days"),
    )


def by_seller(fact: DataFrame, sellers: DataFrame | None = None) -> DataFrame:
    """From the fact or ``agg_order_seller``, keyed by seller and position; a missing position is a key too.

    Or from ``agg_order_seller_id`` with ``sellers``, a ``seller_side``.
    """
    return seller_figures(
        sliced(fact, order_seller),
        [*SELLER, *PLACE],
        late_share(1.0).alias("late_rate"),
        sellers,
        avg_review_score="avg_review_score",
        avg_approval_wait_hours="approval_wait_hours",
    )


def build_rollups(orders: DataFrame, slices: Mapping[str, DataFrame], days: DataFrame | None = None) -> dict[str, DataFrame]:
    """The small rollups by table name, from the stored order rollup, slices and bitmaps of customers."""
    return {
        "agg_state_monthly": state_monthly(orders, days),
        "agg_category": by_category(slices["agg_order_category"]),
        "agg_seller": by_seller(slices["agg_order_seller"]),
    }
