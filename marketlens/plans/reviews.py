"""What goes with good and bad reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.classes import SCORE_BUCKETS, rank_in, score_bucket
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.quantiles import box_statistics, medians
from marketlens.operators.ranking import top_per_group

DRIVERS = ["delay_days", "transit_days", "freight_ratio", "seller_customer_distance_km"]


def _scored(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    scored = apply_filters(fact, spec).where(F.col("min_review_score").isNotNull())
    return scored.withColumn("score_bucket", score_bucket())


def driver_rows(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row per reviewed item: score bucket and possible causes."""
    return _scored(fact, spec).select("score_bucket", *DRIVERS)


def driver_medians(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return medians(driver_rows(fact, spec), ["score_bucket"], DRIVERS)


def driver_boxes(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Distribution of each possible cause in each score bucket."""
    return box_statistics(driver_rows(fact, spec), ["score_bucket"], DRIVERS)


def driver_top3(fact: DataFrame, spec: FilterSpec = FilterSpec(), n: int = 3) -> DataFrame:
    """The categories and customer states with most items in each score bucket."""
    long = (
        _scored(fact, spec)
        .select(
            "score_bucket",
            F.col("product_category_name_english").alias("category"),
            F.col("customer_state").alias("state"),
        )
        .unpivot("score_bucket", ["category", "state"], "dimension", "value")
        .where(F.col("value").isNotNull())
    )
    counted = long.groupBy("score_bucket", "dimension", "value").agg(F.count(F.lit(1)).alias("items"))
    return top_per_group(counted, n, ["score_bucket", "dimension"], "items", ["value"])


def driver_summary(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Medians and the leading categories and states, one row per score bucket."""
    leaders = driver_top3(fact, spec)

    def named(dimension: str):
        hits = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("rank", "value")))  # at most three
        return F.array_join(F.sort_array(hits)["value"], ", ")

    tops = leaders.groupBy("score_bucket").agg(
        named("category").alias("top_categories"), named("state").alias("top_states")
    )
    summary = driver_medians(fact, spec).join(tops, "score_bucket", "left")
    return summary.orderBy(rank_in("score_bucket", SCORE_BUCKETS))
