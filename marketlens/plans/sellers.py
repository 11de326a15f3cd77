"""Ranking of sellers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.classes import bubble_size, late_flag, quadrant, review_flag
from marketlens.functions.text import grouped_number, plain_number, reais, short_id, title_case
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.ranking import ascending, descending, largest, smallest
from marketlens.plans.slices import SELLER, late_share, order_seller, seller_figures, sliced


def _sellers(fact: DataFrame, spec: FilterSpec, min_orders: int, sellers: DataFrame | None = None) -> DataFrame:
    """From the fact or ``agg_order_seller``; with ``sellers``, a ``seller_side``, from ``agg_order_seller_id``."""
    if sellers is not None and spec.seller_states:
        sellers = sellers.where(F.col("seller_state").isin(*spec.seller_states))
        spec = replace(spec, seller_states=())
    found = seller_figures(
        sliced(apply_filters(fact, spec), order_seller),
        SELLER,
        late_share(100.0).alias("late_pct"),
        sellers,
        seller_lat="seller_lat",
        seller_lng="seller_lng",
        avg_review_score="avg_review_score",
        avg_approval_wait_hours="approval_wait_hours",
    )
    return found.where(F.col("order_count") >= min_orders)


def leaderboard(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    return _sellers(fact, spec, min_orders, sellers).orderBy(*descending("gmv"), *ascending(*SELLER))


def kpis(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    """Means weigh each seller once."""
    return _sellers(fact, spec, min_orders, sellers).agg(
        F.count(F.lit(1)).alias("n_sellers"),
        F.sum("gmv").alias("total_gmv"),
        F.avg("avg_review_score").alias("avg_review_score"),
        F.avg("late_pct").alias("avg_late_pct"),
    )


def quadrants(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    """Sellers with score, lateness and value: flags, quadrant, size, short id."""
    placed = _sellers(fact, spec, min_orders, sellers).dropna(subset=["avg_review_score", "late_pct", "gmv"])
    return placed.select(
        "*",
        review_flag().alias("review_flag"),
        late_flag().alias("late_flag"),
        quadrant().alias("quadrant"),
        bubble_size().alias("bubble_size"),
        short_id("seller_id", 12).alias("short_id"),
    )


def display(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    """Leaderboard as shown in a table."""
    return leaderboard(fact, spec, min_orders, sellers).select(
        short_id("seller_id", 12).alias("seller"),
        title_case("seller_city").alias("city"),
        F.col("seller_state").alias("state"),
        F.col("order_count").alias("orders"),
        "gmv",
        F.col("avg_review_score").alias("avg_review"),
        "late_pct",
        F.col("avg_approval_wait_hours").alias("approval_wait_hours"),
        F.col("category_count").alias("categories"),
        review_flag().alias("review_flag"),
        late_flag().alias("late_flag"),
    )


def spotlight(
    fact: DataFrame, seller_id: str, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    """One seller's line of the leaderboard with its card texts.

    The id is a filter on the grouping key, so it reaches the scan; files are sorted by
    seller, so most row groups are skipped.
    """
    chosen = _sellers(fact, spec, min_orders, sellers).where(F.col("seller_id") == seller_id)
    return chosen.select(
        "*",
        F.concat(title_case("seller_city"), F.lit(", "), F.col("seller_state")).alias("location"),
        grouped_number("order_count").alias("orders_label"),
        reais("gmv").alias("gmv_label"),
        plain_number("avg_review_score", 2).alias("review_label"),
        F.concat(plain_number("late_pct", 1), F.lit("%")).alias("late_label"),
    )


def top5(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 10, sellers: DataFrame | None = None
) -> DataFrame:
    best = largest(_sellers(fact, spec, min_orders, sellers), 5, "gmv", SELLER)
    return best.select(
        short_id("seller_id", 12).alias("seller"),
        "seller_city", "seller_state", "order_count", "gmv", "avg_review_score", "late_pct",
    )


def worst5(
    fact: DataFrame,
    spec: FilterSpec = FilterSpec(),
    min_orders: int = 10,
    problem_orders: int = 50,
    sellers: DataFrame | None = None,
) -> DataFrame:
    """Lowest review scores among sellers with enough orders."""
    enough = _sellers(fact, spec, min_orders, sellers).where(F.col("order_count") >= problem_orders)
    worst = smallest(enough, 5, "avg_review_score", ["gmv"], SELLER)
    return worst.select(
        short_id("seller_id", 12).alias("seller"),
        "seller_city", "seller_state", "order_count", "avg_review_score", "late_pct",
        review_flag().alias("review_flag"),
    )
