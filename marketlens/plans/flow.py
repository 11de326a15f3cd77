"""Trade flows from seller state to customer state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import grain_of
from marketlens.functions.text import grouped_number, or_not_available, plain_number, reais
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.ranking import largest
from marketlens.plans.slices import order_flow, order_route, sliced

ROUTE = ["seller_state", "customer_state"]


def crosses_states() -> Column:
    """An unknown state differs from every state."""
    return F.coalesce(F.col("seller_state") != F.col("customer_state"), F.lit(True))


def routes(fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 50) -> DataFrame:
    """From the fact or ``agg_order_route``."""
    rows = sliced(apply_filters(fact, spec), order_route)
    m = grain_of(rows)
    return (
        rows.groupBy(*ROUTE)
        .agg(
            m.mean("seller_lat").alias("seller_lat"),
            m.mean("seller_lng").alias("seller_lng"),
            m.mean("customer_lat").alias("customer_lat"),
            m.mean("customer_lng").alias("customer_lng"),
            m.orders().alias("order_count"),
            m.gmv().alias("gmv"),
            m.mean("delay_days").alias("avg_delay_days"),
            m.mean("seller_customer_distance_km").alias("avg_distance_km"),
        )
        .where(F.col("order_count") >= min_orders)
    )


def kpis(fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 50) -> DataFrame:
    """Cross-state routes, value, and the state selling and the state buying most.

    Orders are summed over routes, so one with sellers in two states counts twice.
    """
    rows = sliced(apply_filters(fact, spec), order_flow)
    m = grain_of(rows)
    counted = rows.groupBy(*ROUTE).agg(m.orders().alias("order_count"), m.gmv().alias("gmv"))
    summed = (
        counted.where(F.col("order_count") >= min_orders)
        .withColumn("crosses", crosses_states())
        .groupingSets([["seller_state"], ["customer_state"], []], *ROUTE)
        .agg(
            F.grouping("seller_state").alias("all_sellers"),
            F.grouping("customer_state").alias("all_buyers"),
            F.sum("order_count").alias("orders"),
            F.sum("gmv").alias("gmv"),
            F.count_if("crosses").alias("cross_routes"),
        )
    )
    overall = (F.col("all_sellers") == 1) & (F.col("all_buyers") == 1)

    def top(state: str, grouped: Column) -> Column:
        named = grouped & F.col(state).isNotNull()
        # Smallest of (-orders, state): most orders first, then the first state.
        return F.min(F.when(named, F.struct((-F.col("orders")).alias("rank"), F.col(state).alias("state"))))["state"]

    return summed.agg(
        F.coalesce(F.max(F.when(overall, F.col("cross_routes"))), F.lit(0)).alias("cross_state_routes"),
        F.max(F.when(overall, F.col("gmv"))).alias("total_gmv"),
        top("seller_state", F.col("all_sellers") == 0).alias("top_seller_state"),
        top("customer_state", F.col("all_buyers") == 0).alias("top_buyer_state"),
    )


def matrix(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Orders of every route between known states, in long form."""
    rows = sliced(apply_filters(fact, spec).dropna(subset=ROUTE), order_flow)
    return rows.groupBy(*ROUTE).agg(grain_of(rows).orders().alias("order_count"))


def matrix_wide(long: DataFrame, customer_states: list[str]) -> DataFrame:
    """The matrix with one column per customer state, 0 where there is no route."""
    return long.groupBy("seller_state").pivot("customer_state", customer_states).agg(F.first("order_count")).fillna(0)


def top_routes(fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 50, n: int = 20) -> DataFrame:
    crossing = routes(fact, spec, min_orders).where(crosses_states())
    return largest(crossing, n, "order_count", ROUTE).select(
        *ROUTE, "order_count", "gmv", "avg_delay_days", "avg_distance_km"
    )


def route_labels(top: DataFrame) -> DataFrame:
    """Top routes as shown in a table."""
    return top.select(
        F.col("seller_state").alias("seller"),
        F.col("customer_state").alias("buyer"),
        F.col("order_count").alias("orders"),
        reais("gmv").alias("gmv_label"),
        or_not_available(plain_number("avg_delay_days", 1)).alias("avg_delay_label"),
        or_not_available(grouped_number("avg_distance_km")).alias("avg_distance_label"),
    )
