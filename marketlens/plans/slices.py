"""Rollups of orders by what their items may differ in: seller, category, seller state.

A distinct count of orders by seller has to bring every order id together, for each page anew. These tables have done that
once: a row stands for all items that one order has with one seller, in one category or from one state, so orders are counted by adding
up, and every condition on what an order fixes (date, customer's state, status) holds for whole rows. They form a lattice over the
fact; ``operators.filters.pick`` names the coarsest one that a page and its filter allow. Where only the fact will do, the
page makes the same rows from the filtered items, so there is one way of counting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.measures import COPIES, COUNTS, ITEMS, ORDER_VALUE, weighed
from marketlens.plans.etl import distinct_sellers
from marketlens.sources.tables import MONTH_KEY

CATEGORY = "product_category_name_english"
SELLER = ["seller_id", "seller_city", "seller_state"]
PLACE = ["seller_lat", "seller_lng"]
# What an order fixes and the pages of sellers, categories and routes look at.
ORDER_KEYS = [
    "order_id",
    "customer_state",
    "customer_lat",
    "customer_lng",
    "order_status",
    "order_purchase_timestamp",
    "avg_review_score",
    "approval_wait_hours",
    "transit_days",
    "delay_days",
    "is_late",
]
# The same of pages that count orders and add up values by route.
FLOW_KEYS = ["order_id", "customer_state", "order_status", "order_purchase_timestamp"]


def _rows(fact: DataFrame, by: Sequence[str], sums: Sequence[str] = (), keys: Sequence[str] = ORDER_KEYS) -> DataFrame:
    """One row per order and value of ``by``; of ``sums``, which items differ in, total and number of values."""
    count, total = weighed(fact)
    totals = [c for name in sums for c in (total(name).alias(f"{name}_sum"), count(F.col(name)).alias(f"{name}_n"))]
    grouped = fact.groupBy(*keys, MONTH_KEY, *by).agg(
        count(F.lit(1)).alias(ITEMS), total("total_item_value").alias(ORDER_VALUE), *totals
    )
    return grouped.select(*[c for c in grouped.columns if c != MONTH_KEY], MONTH_KEY)  # names the folders when stored


def order_seller(fact: DataFrame) -> DataFrame:
    """By order, seller and category; of the rows an order has with a seller only the first counts the order.

    Keeping categories apart lets a page count a seller's categories in two plain aggregates.
    """
    return _first_counts(_rows(fact, [*SELLER, *PLACE, CATEGORY]), SELLER)


def order_seller_id(items: DataFrame) -> DataFrame:
    """The same by seller id, from items that have met no seller's columns: pages join the sellers to the sums of an id.

    An id that many sellers have then costs a row per order, not one per order and seller.
    """
    return _first_counts(_rows(items.drop(COPIES), ["seller_id", CATEGORY]), ["seller_id"])


def _first_counts(rows: DataFrame, seller: Sequence[str]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("order_id", *seller).orderBy(CATEGORY)) == 1
    return rows.withColumn(COUNTS, first.cast("int")).select(*rows.columns[:-1], COUNTS, MONTH_KEY)


def order_category(fact: DataFrame) -> DataFrame:
    return _rows(fact, [CATEGORY], ["price", "freight_ratio"])


def order_route(fact: DataFrame) -> DataFrame:
    """By order and seller state; with the customer's state that is a route."""
    return _rows(fact, ["seller_state"], [*PLACE, "seller_customer_distance_km"])


def order_flow(fact: DataFrame) -> DataFrame:
    """The same without positions and distances, for which each seller has to be met."""
    return _rows(fact, ["seller_state"], keys=FLOW_KEYS)


# Stored tables by name, with what makes them.
SLICES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "agg_order_route": order_route,
    "agg_order_category": order_category,
    "agg_order_seller": order_seller,
}


def sliced(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of a stored slice as they are; items are brought to its grain."""
    return df if ITEMS in df.columns else make(df)


def seller_figures(
    rows: DataFrame, keys: Sequence[str], late: Column, sellers: DataFrame | None = None, **means: str
) -> DataFrame:
    """Figures of each group of ``order_seller`` rows; ``means`` weigh each item once.

    First by group and category, then by group, so categories are counted without a distinct count. With ``sellers``, a
    ``seller_side``, rows are those of ``order_seller_id``: figures of an id go to each group that has sellers of it.
    """
    ids = keys if sellers is None else ["seller_id"]
    placed = {} if sellers is None else {name: column for name, column in means.items() if column in PLACE}
    parts = {
        "orders": F.sum(COUNTS), "value": F.sum(ORDER_VALUE), "n_items": F.sum(ITEMS),
        "n_late": F.sum(F.when(F.col("is_late"), F.col(ITEMS)).otherwise(0)),
    }
    own = {name: column for name, column in means.items() if name not in placed}
    for name, column in own.items():
        value = F.col(column).cast("double")
        parts[f"sum_{name}"] = F.sum(value * F.col(ITEMS))
        parts[f"n_{name}"] = F.sum(F.when(value.isNotNull(), F.col(ITEMS)))
    by_category = rows.groupBy(*ids, CATEGORY).agg(*[c.alias(name) for name, c in parts.items()])
    figures = by_category.groupBy(*ids).agg(
        *[F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(name) for name in own],
        F.sum("orders").alias("order_count"),
        F.sum("value").alias("gmv"),
        late,
        F.count(CATEGORY).alias("category_count"),
        *([] if sellers is None else [F.sum("n_items").alias(ITEMS)]),
    )
    if sellers is None:
        return figures
    homes = distinct_sellers(sellers, *SELLER[1:], *PLACE)
    count, total = weighed(homes)
    sums = [c for name, column in placed.items() for c in (total(column).alias(f"sum_{name}"), count(F.col(column)).alias(f"n_{name}"))]
    grouped = homes.groupBy(*keys).agg(count(F.lit(1)).alias(COPIES), *sums)
    # An item counts once for each seller of its id.
    shown = {name: F.try_divide(F.col(f"sum_{name}") * F.col(ITEMS), F.col(f"n_{name}") * F.col(ITEMS)) for name in placed}
    shown["gmv"] = F.col("gmv") * F.col(COPIES)
    names = [*means, *[c for c in figures.columns if c not in {"seller_id", ITEMS, *means}]]
    return figures.join(grouped, "seller_id").select(*keys, *[shown[c].alias(c) if c in shown else c for c in names])


def late_share(scale: float) -> Column:
    """Late items per ``scale`` items, over the sums of ``seller_figures``."""
    return F.try_divide(F.sum("n_late") * F.lit(scale), F.sum("n_items"))
