"""The whole data preparation: CSV in, Parquet tables out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.timing import month_start
from marketlens.plans.customers import customer_days, new_numbers, number_customers
from marketlens.plans.etl import balanced_fact, geo_centroids, order_measures, order_side, seller_side
from marketlens.plans.histories import customer_histories, merged_histories
from marketlens.plans.quality import quality_checks
from marketlens.plans.rollups import build_rollups, by_order, state_monthly
from marketlens.plans.slices import SLICES
from marketlens.session import JOIN_BYTES, discard, size_for, stage, stored_bytes, tune
from marketlens.sources.raw import RAW_SCHEMAS, read_raw
from marketlens.sources.tables import MONTH_KEY, balanced, replace_months, write_fact, write_table, write_tables


# So that the filter of the seller card skips row groups.
SORTED = {"agg_order_seller": ("seller_id",), "agg_order_seller_id": ("seller_id",)}


class QualityError(ValueError):
    """A prepared table fails a check."""


def prepare(
    spark: SparkSession,
    raw_paths: Mapping[str, str] | str,
    folder: str,
    late_share: tuple[float, float] | None = None,
) -> DataFrame:
    """Read, clean, enrich and roll up; returns the checks.

    Every step reads what the step before has written, so a failure repeats one
    step and the fact is joined once for all rollups. Late items fail a check only if
    ``late_share`` says what share of all items is expected.
    """
    folder = folder.rstrip("/")
    tune(spark)
    write_tables(read_raw(spark, raw_paths), folder)
    size_for(spark, stored_bytes(spark, folder), JOIN_BYTES)
    raw = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in RAW_SCHEMAS}
    centroids = spark.read.parquet(write_table(geo_centroids(raw["geolocation"]), folder, "geo_centroids"))
    staged = [side := stage(order_side(raw, centroids), "order_side")]
    try:
        staged.append(sellers := stage(seller_side(raw, centroids), "seller_side"))
        fact = write_fact(balanced_fact(raw, centroids, side, sellers), f"{folder}/orders_enriched.parquet", "seller_id")
        orders = write_fact(balanced(by_order(fact, order_measures(side))), f"{folder}/agg_order.parquet")
    finally:
        discard(*staged)
    slices = {name: write_fact(balanced(make(fact)), f"{folder}/{name}.parquet", *SORTED.get(name, ())) for name, make in SLICES.items()}
    numbers = spark.read.parquet(write_table(number_customers(orders), folder, "dim_customer"))
    days = write_fact(balanced(customer_days(orders, numbers)), f"{folder}/agg_customer_day.parquet")
    write_table(customer_histories(orders), folder, "agg_customer")
    write_tables(build_rollups(orders, slices, days), folder)
    return quality_checks(fact, raw["order_items"], raw["geolocation"], centroids, orders, late_share=late_share)


def refresh(spark: SparkSession, raw_paths: Mapping[str, str] | str, folder: str, months: Iterable[date]) -> None:
    """Bring the prepared tables in ``folder`` up to date for the orders bought in some months.

    ``raw_paths`` has raw tables with all rows of these months' orders, whatever else they hold; ``months`` are given by their first day.
    An order that moved needs both its months. Only the folders of these months are rewritten, in the fact, the order rollup and
    the slices; the monthly rollup and the customers' histories keep what they have of other months, the rollups by category and
    seller are added up anew from the slices.
    Positions of zip codes stay as they were stored, as do the Parquet copies of the raw tables.
    """
    folder, months = folder.rstrip("/"), sorted({month.replace(day=1) for month in months})
    tune(spark)
    raw = dict(read_raw(spark, raw_paths))
    raw["orders"] = raw["orders"].where(month_start("order_purchase_timestamp").isin(*months))
    centroids = spark.read.parquet(f"{folder}/geo_centroids.parquet")
    side = stage(order_side(raw, centroids), "order_side")
    # Built aside first: the counts of what is new come from tables, not from joins run once more.
    staged = [side]
    try:
        sellers = stage(seller_side(raw, centroids), "seller_side")
        staged.append(sellers)
        items = stage(balanced_fact(raw, centroids, side, sellers), "refreshed_items")
        staged.append(items)
        fact = replace_months(balanced(items), f"{folder}/orders_enriched.parquet", months, "seller_id")
        by_orders = stage(by_order(items, order_measures(side)), "refreshed_orders")
        staged.append(by_orders)
        replace_months(balanced(by_orders), f"{folder}/agg_order.parquet", months)
        fresh_numbers = stage(new_numbers(by_orders, spark.read.parquet(f"{folder}/dim_customer.parquet")), "new_customers")
        staged.append(fresh_numbers)
        # Numbers are stored ahead of the bitmaps; if what follows fails they are merely not used yet.
        fresh_numbers.write.mode("append").parquet(f"{folder}/dim_customer.parquet")
        days = stage(customer_days(by_orders, spark.read.parquet(f"{folder}/dim_customer.parquet")), "refreshed_customers")
        staged.append(days)
        replace_months(balanced(days), f"{folder}/agg_customer_day.parquet", months)
        for name, make in SLICES.items():
            rows = stage(make(fact), name)
            staged.append(rows)
            replace_months(balanced(rows), f"{folder}/{name}.parquet", months, *SORTED.get(name, ()))
        monthly = spark.read.parquet(f"{folder}/agg_state_monthly.parquet")
        merged = monthly.where(~F.col(MONTH_KEY).isin(*months)).unionByName(state_monthly(by_orders, days))
        slices = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in SLICES}
        histories = merged_histories(spark.read.parquet(f"{folder}/agg_customer.parquet"), by_orders, months)
        rollups = {**build_rollups(by_orders, slices), "agg_state_monthly": merged, "agg_customer": histories}
        fresh = {name: stage(df, name) for name, df in rollups.items()}  # a table can't be replaced while it is read
        staged += fresh.values()
        write_tables(fresh, folder)
    finally:
        discard(*staged)


def require(checks: DataFrame) -> None:
    """Raise if a check failed."""
    failed = [row["check"] for row in checks.where("NOT passed").collect()]  # a handful of rows
    if failed:
        raise QualityError(f"failed checks: {failed}")
