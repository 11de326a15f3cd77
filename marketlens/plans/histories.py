"""A row per customer with the days of all purchases, from which cohorts and repeat purchases are read without a shuffle of ids.

Which purchase founds a cohort depends on the dates and states asked for, so neither the cohort nor a number of orders can be stored.
What is stored is small: ``history`` has a struct for each day and state a customer bought in, with the number of orders. A
page then works on each row by itself and only its counts travel.

A history is as long as the customer has purchase days, however many orders these hold: orders are counted by customer and day
before a customer's days meet. A refresh takes the days of some months out of every history and puts the new ones in.

Customers without id have no row. Purchases without a day stay, as an entry without one.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.timing import month_start, months_between_starts
from marketlens.operators.filters import FilterSpec
from marketlens.plans.customers import CUSTOMER, PURCHASE, STATE, until_midnight

HISTORY = "history"
ENTRY = ["day", "until", "state", "orders"]


def _entries(orders: DataFrame) -> DataFrame:
    day = F.to_date(PURCHASE)
    known = orders.where(F.col(CUSTOMER).isNotNull())
    by_day = known.groupBy(CUSTOMER, day.alias("day"), until_midnight(PURCHASE).alias("until"), F.col(STATE).alias("state"))
    return by_day.agg(F.count(F.lit(1)).alias("orders"))


def _gathered(entries: DataFrame) -> DataFrame:
    return entries.groupBy(CUSTOMER).agg(F.collect_list(F.struct(*ENTRY)).alias(HISTORY))


def customer_histories(orders: DataFrame) -> DataFrame:
    """``customer_unique_id`` and ``history``; reads the order rollup once."""
    return _gathered(_entries(orders))


def merged_histories(histories: DataFrame, orders: DataFrame, months: Iterable[date]) -> DataFrame:
    """The histories with ``orders``, all of which were bought in ``months``, in place of what they had of these months."""
    replaced = sorted(set(months))
    kept = F.filter(HISTORY, lambda e: F.coalesce(~month_start(e["day"]).isin(*replaced), F.lit(True)))
    return _gathered(histories.select(CUSTOMER, F.inline(kept)).unionByName(_entries(orders)))


def answers(spec: FilterSpec) -> bool:
    """Whether histories know which purchases meet the conditions: those on dates and states."""
    return not (spec.looks_at_items or spec.statuses)


def _in_states(spec: FilterSpec) -> Column:
    if not answers(spec):
        raise ValueError("conditions on items or statuses need the fact or the order rollup")
    return F.filter(HISTORY, lambda e: e["state"].isin(*spec.states)) if spec.states else F.col(HISTORY)


def _in_dates(spec: FilterSpec, history: Column) -> Column:
    if spec.date_from:
        history = F.filter(history, lambda e: e["day"] >= F.lit(spec.date_from))
    if spec.date_to:
        history = F.filter(history, lambda e: e["until"] <= F.lit(spec.date_to))
    return history


def activity(histories: DataFrame, spec: FilterSpec, *kept: str) -> DataFrame:
    """``kept`` columns, the cohort's month, and each month a customer of it bought in."""
    bought = _in_states(spec)
    first = F.array_min(F.transform(_in_dates(spec, bought), lambda e: e["day"]))
    months = F.array_distinct(F.transform(bought, lambda e: month_start(e["day"])))
    tagged = histories.select(*kept, month_start(first).alias("cohort_month"), months.alias("months"))
    each = tagged.where(F.col("cohort_month").isNotNull()).select(*kept, "cohort_month", F.explode("months").alias("order_month"))
    return each.withColumn("months_since_first", months_between_starts(F.col("cohort_month"), F.col("order_month")))


def orders_per_customer(histories: DataFrame, spec: FilterSpec) -> DataFrame:
    """``orders`` of each customer who has any."""
    counted = F.aggregate(_in_dates(spec, _in_states(spec)), F.lit(0).cast("long"), lambda total, e: total + e["orders"])
    return histories.select(counted.alias("orders")).where("orders > 0")
