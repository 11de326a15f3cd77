"""How far orders get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import ITEMS, grain_of
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.quantiles import medians
from marketlens.operators.ranking import ascending, descending

MILESTONES = {
    "approved": "order_approved_at",
    "carrier_pickup": "order_delivered_carrier_date",
    "delivered": "order_delivered_customer_date",
}


def order_funnel(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Orders that reached each milestone.

    Items are folded to orders once, instead of once per distinct count.
    """
    rows = apply_filters(fact, spec)
    reached = {name: F.col(ts).isNotNull() for name, ts in MILESTONES.items()}
    if ITEMS in fact.columns:
        per_order = rows.select("order_id", *[hit.alias(name) for name, hit in reached.items()])
    else:
        per_order = rows.groupBy("order_id").agg(*[F.bool_or(hit).alias(name) for name, hit in reached.items()])
    return per_order.agg(F.count("order_id").alias("placed"), *[F.count_if(name).alias(name) for name in MILESTONES])


def funnel_stages(funnel: DataFrame) -> DataFrame:
    """The funnel with a row per milestone."""
    return funnel.unpivot([], ["placed", *MILESTONES], "stage", "orders")


def status_breakdown(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Orders per status and the status's share."""
    counted = apply_filters(fact, spec).groupBy("order_status").agg(grain_of(fact).orders().alias("orders"))
    everything = counted.agg(F.sum("orders")).scalar()
    shared = counted.withColumn("pct", F.col("orders") * F.lit(100.0) / everything)
    return shared.orderBy(*descending("orders"), *ascending("order_status"))


def stage_medians(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Median hours in each stage, per status; NULL for a stage not reached."""
    weight = [ITEMS] if ITEMS in fact.columns else []
    rows = apply_filters(fact, spec).select(
        "order_status",
        *weight,
        F.col("approval_wait_hours").alias("approval_hours"),
        F.col("carrier_wait_hours").alias("pickup_hours"),
        (F.col("transit_days").cast("double") * 24).alias("transit_hours"),
    )
    return medians(rows, ["order_status"], ["approval_hours", "pickup_hours", "transit_hours"]).orderBy("order_status")
