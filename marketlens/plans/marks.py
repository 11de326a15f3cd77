"""Marks of the maps: radius, width, colour position and labels per row.

Each takes an aggregated frame, such as the result of another plan; rows and extremes
share its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import grouped_number, or_not_available, plain_number, reais, short_id
from marketlens.operators.scaling import diverging, diverging_extent, position, with_extremes
from marketlens.plans.flow import crosses_states
from marketlens.sources.states import with_state_name

# Smallest size and the size added at the largest value.
STATE_RADIUS = (90_000.0, 190_000.0)
ARC_WIDTH = (2.0, 12.0)
SELLER_RADIUS = (12_000.0, 88_000.0)
DELAY_RADIUS = (80_000.0, 160_000.0)


def _sized(size: tuple[float, float], at):
    least, added = size
    return F.lit(least) + at * F.lit(added)


def _percent(c: str):
    return F.concat(plain_number(c, 1), F.lit("%"))


def state_bubbles(metrics: DataFrame, metric: str = "gmv") -> DataFrame:
    """State bubbles sized and coloured by a metric."""
    label = reais(metric) if metric == "gmv" else grouped_number(metric)
    if metric == "avg_review_score":
        label = plain_number(metric, 2)
    placed = with_extremes(metrics.dropna(subset=["lat", "lng", metric]), metric=F.col(metric))
    at = position(F.col(metric), "metric")
    marks = placed.select(
        "customer_state",
        "lat",
        "lng",
        metric,
        at.alias("color_position"),
        _sized(STATE_RADIUS, at).alias("radius"),
        label.alias("label"),
    )
    return with_state_name(marks)


def flow_arcs(routes: DataFrame, metric: str = "order_count") -> DataFrame:
    """Cross-state arcs: width by orders, colour by a metric, where no value counts as 0."""
    ends = ["seller_lat", "seller_lng", "customer_lat", "customer_lng"]
    shade = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    crossing = routes.dropna(subset=ends).where(crosses_states())
    placed = with_extremes(crossing, orders=F.col("order_count"), shade=shade)
    return placed.select(
        "seller_state",
        "customer_state",
        *ends,
        _sized(ARC_WIDTH, position(F.col("order_count"), "orders", 1.0)).alias("width"),
        position(shade, "shade").alias("color_position"),
        grouped_number("order_count").alias("orders_label"),
        reais("gmv").alias("gmv_label"),
        or_not_available(F.concat(plain_number("avg_delay_days", 1), F.lit(" days"))).alias("delay_label"),
        or_not_available(F.concat(grouped_number("avg_distance_km"), F.lit(" km"))).alias("distance_label"),
    )


def seller_points(sellers: DataFrame) -> DataFrame:
    """Sellers on the map: radius by the log of value, colour by review score."""
    placed = sellers.dropna(subset=["seller_lat", "seller_lng", "avg_review_score", "gmv"])
    log_gmv = F.log1p(F.greatest(F.col("gmv"), F.lit(0.0)))
    placed = with_extremes(placed, score=F.col("avg_review_score"), size=log_gmv)
    return placed.select(
        "seller_id",
        short_id("seller_id", 8).alias("short_id"),
        "seller_city",
        "seller_state",
        "seller_lat",
        "seller_lng",
        position(F.col("avg_review_score"), "score", 0.01).alias("color_position"),
        _sized(SELLER_RADIUS, position(log_gmv, "size")).alias("radius"),
        plain_number("avg_review_score", 2).alias("review_label"),
        reais("gmv").alias("gmv_label"),
        grouped_number("order_count").alias("orders_label"),
        _percent("late_pct").alias("late_label"),
    )


def delay_points(delays: DataFrame) -> DataFrame:
    """States on the map: colour diverging around no delay, radius by its size."""
    placed = with_extremes(delays.dropna(subset=["lat", "lng", "avg_delay_days"]), delay=F.col("avg_delay_days"))
    size = F.abs("avg_delay_days") / diverging_extent("delay")
    sign = F.when(F.col("avg_delay_days") > 0, "+").otherwise("")
    return placed.select(
        "customer_state",
        "lat",
        "lng",
        "avg_delay_days",
        diverging(F.col("avg_delay_days"), "delay").alias("color_position"),
        _sized(DELAY_RADIUS, size).alias("radius"),
        F.concat(sign, plain_number("avg_delay_days", 1)).alias("delay_label"),
        _percent("late_pct").alias("late_label"),
        F.concat(plain_number("avg_transit_days", 1), F.lit(" days")).alias("transit_label"),
    )
