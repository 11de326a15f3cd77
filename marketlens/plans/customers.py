"""Exact counts of different customers that can be added up: dense customer numbers and bitmaps by state and day.

A distinct count by state has to bring every customer id together, for each page anew, and counts of months can't be added, as a
customer may buy in several. So the preparation numbers the customers once and stores, by state and day of purchase, which numbers
bought, as bitmaps of ``BITS`` numbers each. Any range of dates is then the union of bitmaps; no id is read.

Numbers follow state and day of the first purchase, so customers that start together lie side by side and a day's bitmaps
are few and full; only returning customers set single bits elsewhere. A refresh numbers new customers behind the old ones.

Customers without id are not counted, as in a distinct count. Missing states and days are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.filters import FilterSpec
from marketlens.sources.tables import MONTH_KEY

CUSTOMER = "customer_unique_id"
STATE = "customer_state"
PURCHASE = "order_purchase_timestamp"
NUMBER = "customer_no"
BITS = 32_768  # of a bitmap, as the built-in functions have them
PIECES = 16  # of the customers of one state and day, so that no task numbers a hot day alone


def number_customers(orders: DataFrame, after: int = 0) -> DataFrame:
    """``customer_unique_id`` and ``customer_no``, without gaps from ``after`` + 1 on.

    Numbers are places in (state, day, piece), added to the number of customers in the groups before; the groups of one
    state are summed in one task, which has a row for a day and piece.
    """
    first = F.min(F.struct(F.to_date(PURCHASE).alias("day"), F.col(STATE).alias("state")))
    customers = (
        orders.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER)
        .agg(first.alias("first"))
        .select(CUSTOMER, "first.state", "first.day", F.pmod(F.xxhash64(CUSTOMER), F.lit(PIECES)).alias("piece"))
    )
    groups = ["state", "day", "piece"]
    sizes = customers.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("state").orderBy("day", "piece").rowsBetween(Window.unboundedPreceding, -1)
    states = sizes.groupBy("state").agg(F.sum("n").alias("n"))
    # A row for each state.
    above = states.select("state", F.coalesce(F.sum("n").over(Window.orderBy("state").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    offsets = sizes.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("s").join(
        above.alias("a"), F.expr("s.state <=> a.state")
    ).select(*[F.col(f"s.{g}").alias(f"of_{g}") for g in groups], (F.col("inside") + F.col("above")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(CUSTOMER))
    same = F.expr(" AND ".join(f"{g} <=> of_{g}" for g in groups))
    return customers.withColumn("place", place).join(offsets, same).select(
        CUSTOMER, (F.lit(after) + F.col("offset") + F.col("place")).cast("long").alias(NUMBER)
    )


def new_numbers(orders: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers of the customers that have none in ``known``, behind those that are taken."""
    last = known.agg(F.max(NUMBER)).first()[0] or 0
    return number_customers(orders.join(known.select(CUSTOMER), CUSTOMER, "left_anti"), last)


def until_midnight(ts: str) -> Column:
    """The first midnight not before a purchase, as the last day of a date range ends at its midnight."""
    day = F.to_date(ts)
    return F.when(F.col(ts) == F.date_trunc("day", F.col(ts)), day).otherwise(F.date_add(day, 1))


def customer_days(orders: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bitmaps of the customers by state and purchase day; reads the order rollup once."""
    day, number = F.to_date(PURCHASE), F.col(NUMBER)
    rows = orders.select(CUSTOMER, STATE, day.alias("day"), until_midnight(PURCHASE).alias("until"), MONTH_KEY).join(numbers, CUSTOMER)
    return rows.groupBy(STATE, "day", "until", F.bitmap_bucket_number(number).alias("bucket"), MONTH_KEY).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("customers")
    ).select(STATE, "day", "until", "bucket", "customers", MONTH_KEY)


def answers(spec: FilterSpec) -> bool:
    """Whether the bitmaps know which customers meet the conditions: those on dates and states."""
    return not (spec.looks_at_items or spec.statuses)


def _conditions(spec: FilterSpec) -> list[Column]:
    found = []
    if spec.date_from:
        found += [F.col("day") >= F.lit(spec.date_from), F.col(MONTH_KEY) >= F.lit(spec.date_from.replace(day=1))]
    if spec.date_to:
        found += [F.col("until") <= F.lit(spec.date_to), F.col(MONTH_KEY) <= F.lit(spec.date_to.replace(day=1))]
    if spec.states:
        found.append(F.col(STATE).isin(*spec.states))
    return found


def unique_customers(days: DataFrame, spec: FilterSpec, *keys: str) -> DataFrame:
    """Number of different customers (``unique_customers``) by ``keys``, of ``customer_state`` and ``order_year_month``, or in all."""
    if not answers(spec):
        raise ValueError("conditions on items or statuses need the fact or the order rollup")
    for condition in _conditions(spec):
        days = days.where(condition)
    merged = days.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("customers")), F.lit(0)).alias("unique_customers"))


def with_customers(figures: DataFrame, days: DataFrame, spec: FilterSpec, *keys: str) -> DataFrame:
    """Add ``unique_customers`` to a result by ``keys``; both sides have a row for each of their values."""
    counted = unique_customers(days, spec, *keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "unique_customers")
    same = F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys))
    return figures.join(counted, same, "left").select(
        *figures.columns, F.coalesce("unique_customers", F.lit(0)).alias("unique_customers")
    )
