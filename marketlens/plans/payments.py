"""Payment types and instalments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.classes import (
    INSTALLMENT_BUCKETS,
    PAYMENT_LABELS,
    VALUE_TIERS,
    installment_bucket,
    rank_in,
    value_tier,
)
from marketlens.functions.measures import ITEMS, ItemGrain, grain_of
from marketlens.functions.text import label_of
from marketlens.functions.timing import month_start
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.quantiles import box_statistics
from marketlens.operators.ranking import ascending, descending

TYPE = "primary_payment_type"


def kpis(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Shares are per item with a known payment type."""
    m, known = grain_of(fact), F.col(TYPE).isNotNull()
    return apply_filters(fact, spec).agg(
        m.orders().alias("total_orders"),
        m.pct(F.col(TYPE) == "credit_card", known).alias("cc_pct"),
        m.avg_installments().alias("avg_installments"),
        m.pct(F.col(TYPE) == "boleto", known).alias("boleto_pct"),
    )


def _paid(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    return apply_filters(fact, spec).where(F.col(TYPE).isNotNull())


def mix(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Orders per value tier of an item and payment type, and the type's share of its tier."""
    by_tier = _paid(fact, spec).groupBy(value_tier().alias("value_tier"), TYPE)
    counted = by_tier.agg(ItemGrain().orders().alias("order_count"))
    in_tier = F.sum("order_count").over(Window.partitionBy("value_tier"))
    return counted.select(
        "value_tier",
        TYPE,
        label_of(TYPE, PAYMENT_LABELS).alias("payment_label"),
        "order_count",
        (F.col("order_count") / in_tier * 100).alias("pct"),
    ).orderBy(rank_in("value_tier", VALUE_TIERS), *ascending(TYPE))


def installments_monthly(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Mean instalments of credit-card items per month."""
    card = apply_filters(fact, spec).where((F.col("max_installments") > 0) & (F.col(TYPE) == "credit_card"))
    by_month = card.groupBy(month_start("order_purchase_timestamp").alias("month"))
    m = grain_of(fact)
    return by_month.agg(
        m.mean("max_installments").alias("avg_installments"), m.orders().alias("orders")
    ).orderBy("month")


def installment_orders(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row per order that has instalments and a review: bucket and score."""
    rated = apply_filters(fact, spec).where((F.col("max_installments") > 0) & F.col("avg_review_score").isNotNull())
    if ITEMS not in fact.columns:
        rated = rated.groupBy("order_id").agg(
            F.max("max_installments").alias("max_installments"), F.max("avg_review_score").alias("avg_review_score")
        )
    return rated.select(installment_bucket().alias("installment_bucket"), "avg_review_score")


def installment_box(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Distribution of the review score of orders in each instalment bucket."""
    boxes = box_statistics(installment_orders(fact, spec), ["installment_bucket"], ["avg_review_score"])
    return boxes.drop("measure").orderBy(rank_in("installment_bucket", INSTALLMENT_BUCKETS))


def type_summary(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    m = grain_of(fact)
    grouped = _paid(fact, spec).groupBy(TYPE).agg(
        m.orders().alias("orders"),
        m.gmv().alias("gmv"),
        m.avg_installments().alias("avg_installments"),
        m.review().alias("avg_review"),
    )
    labelled = grouped.withColumn("payment_label", label_of(TYPE, PAYMENT_LABELS))
    return labelled.orderBy(*descending("orders"), *ascending(TYPE))


def bucket_summary(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    m = grain_of(fact)
    with_any = apply_filters(fact, spec).where(F.col("max_installments") > 0)
    grouped = with_any.groupBy(installment_bucket().alias("installment_bucket")).agg(
        m.orders().alias("orders"), m.review().alias("avg_review"), m.late_pct().alias("late_pct")
    )
    return grouped.orderBy(rank_in("installment_bucket", INSTALLMENT_BUCKETS))
