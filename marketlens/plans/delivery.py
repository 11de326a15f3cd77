"""Delivery times, delays and lifecycle stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import grain_of
from marketlens.functions.classes import LATE, ON_TIME, STAGE_LABELS, delay_status
from marketlens.functions.text import label_of
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.quantiles import medians
from marketlens.operators.ranking import ascending, descending


def kpis(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    m = grain_of(fact)
    figures = apply_filters(fact, spec).agg(
        m.late_pct().alias("late_delivery_pct"),
        m.mean(F.when(F.col("delay_days") > 0, F.col("delay_days"))).alias("avg_delay_when_late"),
        m.mean("transit_days").alias("avg_transit_days"),
        m.orders().alias("total_orders"),
    )
    return figures.withColumn("on_time_pct", F.lit(100.0) - F.col("late_delivery_pct"))


def delay_by_state(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    m = grain_of(fact)
    return apply_filters(fact, spec).groupBy("customer_state").agg(
        m.mean("customer_lat").alias("lat"),
        m.mean("customer_lng").alias("lng"),
        m.mean("delay_days").alias("avg_delay_days"),
        m.late_pct().alias("late_pct"),
        m.mean("transit_days").alias("avg_transit_days"),
    )


def delay_summary(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """States with a delay, most delayed first."""
    table = delay_by_state(fact, spec).drop("lat", "lng").dropna(subset=["avg_delay_days"])
    return table.orderBy(*descending("avg_delay_days"), *ascending("customer_state"))


def stage_breakdown(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Mean days per stage and state, most delayed first."""
    m = grain_of(fact)
    stages = apply_filters(fact, spec).groupBy("customer_state").agg(
        (m.mean("approval_wait_hours") / 24).alias("avg_days_to_approve"),
        (m.mean("carrier_wait_hours") / 24).alias("avg_days_to_pickup"),
        m.mean("transit_days").alias("avg_transit_days"),
        m.mean("delay_days").alias("avg_delay"),
    )
    return stages.orderBy(*descending("avg_delay"), *ascending("customer_state"))


def stage_breakdown_long(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row per state and stage, with the stage's label."""
    melted = stage_breakdown(fact, spec).unpivot("customer_state", list(STAGE_LABELS), "stage", "days")
    return melted.withColumn("stage", label_of("stage", STAGE_LABELS))


def delay_histogram(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Delivered items per day of delay, split into late and not late."""
    delivered = apply_filters(fact, spec).where(F.col("delay_days").isNotNull())
    bins = delivered.groupBy(F.floor("delay_days").alias("delay_bin"), delay_status().alias("status"))
    return bins.agg(grain_of(fact).items().alias("items")).orderBy("delay_bin", "status")


def delay_medians(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Late and early items and the median delay of each side, in one row."""
    delivered = apply_filters(fact, spec).where(F.col("delay_days").isNotNull())
    sides = medians(delivered.withColumn("status", delay_status()), ["status"], ["delay_days"])
    late, early = F.col("status") == LATE, F.col("status") == ON_TIME
    return sides.agg(
        F.coalesce(F.max(F.when(late, F.col("n"))), F.lit(0)).alias("n_late"),
        F.coalesce(F.max(F.when(early, F.col("n"))), F.lit(0)).alias("n_early"),
        F.max(F.when(late, F.col("median_delay_days"))).alias("median_late"),
        F.max(F.when(early, F.col("median_delay_days"))).alias("median_early"),
    )
