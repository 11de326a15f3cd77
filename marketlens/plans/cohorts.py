"""Customer cohorts and repeat purchases, from the fact, the order rollup or the stored histories of the customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.measures import ItemGrain, grain_of
from marketlens.functions.timing import month_start, months_between_starts
from marketlens.operators.filters import FilterSpec, apply_filters, in_date_range
from marketlens.plans import histories

CUSTOMER = "customer_unique_id"
PURCHASE = "order_purchase_timestamp"


def activity(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Months in which each customer bought, with the month of the first purchase.

    The date range decides which purchase founds the cohort, not which months
    count, so both come from one pass: purchases are first folded to one row per
    customer and month, and only those rows meet in a window. Histories need none.
    """
    if histories.HISTORY in fact.columns:
        return histories.activity(fact, spec, CUSTOMER)
    rows = apply_filters(fact, spec.without_dates()).where(F.col(CUSTOMER).isNotNull())
    founding = reduce(lambda a, b: a & b, in_date_range(spec), F.lit(True))
    months = rows.groupBy(CUSTOMER, month_start(PURCHASE).alias("order_month")).agg(
        F.min(F.when(founding, F.col(PURCHASE))).alias("first_purchase")
    )
    first = F.min("first_purchase").over(Window.partitionBy(CUSTOMER))
    tagged = months.withColumn("cohort_month", month_start(first)).where(F.col("cohort_month").isNotNull())
    since = months_between_starts(F.col("cohort_month"), F.col("order_month"))
    return tagged.select(CUSTOMER, "cohort_month", "order_month", since.alias("months_since_first"))


def retention(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Customers of a cohort active after so many months, and their share of it."""
    # A customer has one row per month, so rows are distinct customers.
    active = activity(fact, spec).groupBy("cohort_month", "months_since_first").agg(
        F.count(F.lit(1)).alias("active_customers")
    )
    # Everyone is active in the founding month.
    founders = F.when(F.col("months_since_first") == 0, F.col("active_customers"))
    size = F.max(founders).over(Window.partitionBy("cohort_month"))
    return active.withColumn("cohort_size", size).withColumn(
        "retention_pct", F.col("active_customers") * F.lit(100.0) / F.col("cohort_size")
    )


def retention_wide(long: DataFrame, months: list[int]) -> DataFrame:
    """Cohorts in rows, months since the first purchase in columns."""
    return long.groupBy("cohort_month").pivot("months_since_first", months).agg(F.first("retention_pct"))


def repeat_kpis(fact: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Share of customers with more than one order, and their mean number of orders."""
    if histories.HISTORY in fact.columns:
        per_customer = histories.orders_per_customer(fact, spec)
    else:
        by_customer = apply_filters(fact, spec).where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER)
        per_customer = by_customer.agg(grain_of(fact).orders().alias("orders"))
    returning = F.col("orders") > 1
    return per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(returning).alias("returning_customers"),
        ItemGrain().pct(returning).alias("repeat_rate_pct"),
        F.avg(F.when(returning, F.col("orders"))).alias("avg_orders_returning"),
    )
