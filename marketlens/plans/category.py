"""Scorecard of product categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import grain_of
from marketlens.functions.classes import bubble_size, freight_flag, late_flag, quadrant, review_flag
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.ranking import ascending, descending, largest, smallest
from marketlens.plans.slices import order_category, sliced

UNKNOWN = "Unknown"


def _categories(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    """From the fact or ``agg_order_category``."""
    category = F.coalesce("product_category_name_english", F.lit(UNKNOWN)).alias("category")
    rows = sliced(apply_filters(fact, spec), order_category)
    m = grain_of(rows)
    return rows.groupBy(category).agg(
        m.orders().alias("order_count"),
        m.gmv().alias("gmv"),
        m.mean("price").alias("avg_price"),
        m.mean("freight_ratio").alias("avg_freight_ratio"),
        m.review().alias("avg_review_score"),
        m.late_pct().alias("late_pct"),
        m.mean("transit_days").alias("avg_transit_days"),
    )


def scorecard(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Categories by value; items without one are 'Unknown'."""
    return _categories(fact, spec).orderBy(*descending("gmv"), *ascending("category"))


def kpis(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Means weigh each category once."""
    return _categories(fact, spec).agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum("gmv").alias("total_gmv"),
        F.avg("avg_review_score").alias("avg_review_score"),
        F.avg("late_pct").alias("avg_late_pct"),
    )


def flags(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Scorecard with the colour of each judged cell; NULL means none."""
    return scorecard(fact, spec).select(
        "*", review_flag().alias("review_flag"), late_flag().alias("late_flag"), freight_flag().alias("freight_flag")
    )


def quadrants(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Categories with score, lateness and value, placed in a quadrant."""
    placed = _categories(fact, spec).dropna(subset=["avg_review_score", "late_pct", "gmv"])
    return placed.select("*", quadrant().alias("quadrant"), bubble_size().alias("bubble_size"))


def top5(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    best = largest(_categories(fact, spec), 5, "gmv", ["category"])
    return best.select("category", "gmv", "avg_review_score", "late_pct")


def worst5(fact: DataFrame, spec: FilterSpec = FilterSpec(), min_orders: int = 50) -> DataFrame:
    """Lowest review scores among categories with enough orders."""
    enough = _categories(fact, spec).where(F.col("order_count") >= min_orders)
    worst = smallest(enough, 5, "avg_review_score", ["gmv"], ["category"])
    return worst.select("category", "avg_review_score", "late_pct", "order_count", review_flag().alias("review_flag"))
