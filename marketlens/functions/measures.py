"""Aggregates of the report pages.

Counts of orders are distinct; averages and rates weigh each item once. A page
works on the item-grain fact, or on a rollup where each row stands for all items of one
order, or for those of them that share a seller, category or state. ``grain_of`` gives the aggregates for either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the order rollup: how many items a row stands for, and their value.
ITEMS = "items"
ORDER_VALUE = "order_value"
# 1 on the row that counts its order, where a rollup has several rows of an order in a group.
COUNTS = "counts_order"
# Of an item that stands for several rows of the fact, as several sellers have its seller's id: how many.
COPIES = "copies"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighed(df: DataFrame) -> tuple[Callable[[Column], Column], Callable[[str | Column], Column]]:
    """Count and sum over items, each as often as its ``COPIES`` say, if it has any."""
    if COPIES not in df.columns:
        return F.count, F.sum
    copies = F.col(COPIES)
    return (
        lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), copies)), F.lit(0)),
        lambda c: F.sum(_column(c).cast("double") * copies),
    )


class ItemGrain:
    """Rows are items."""

    def orders(self) -> Column:
        return F.count_distinct("order_id")

    def items(self, hit: Column | None = None) -> Column:
        """Items, or those for which ``hit`` holds."""
        return F.count(F.lit(1)) if hit is None else F.count_if(hit)

    def mean(self, c: str | Column) -> Column:
        return F.avg(c)

    def gmv(self) -> Column:
        return F.sum("total_item_value")

    def customers(self) -> Column:
        return F.count_distinct("customer_unique_id")

    def review(self) -> Column:
        return self.mean("avg_review_score")

    def rate(self, hit: Column) -> Column:
        """Share of items for which ``hit`` holds, 0 to 1; NULL over no rows."""
        return F.try_divide(self.items(hit).cast("double"), self.items())

    def pct(self, hit: Column, among: Column | None = None) -> Column:
        """Items for which ``hit`` holds per 100 items, or per 100 for which ``among`` holds."""
        return F.try_divide(self.items(hit) * F.lit(100.0), self.items(among))

    def late_rate(self) -> Column:
        return self.rate(F.col("is_late"))

    def late_pct(self) -> Column:
        return self.pct(F.col("is_late"))

    def avg_installments(self) -> Column:
        """Mean instalments over the items that have any."""
        return self.mean(F.when(F.col("max_installments") > 0, F.col("max_installments")))


class OrderGrain(ItemGrain):
    """Rows are orders, or an order's items of one group, so that counting them needs no shuffle of their ids."""

    def __init__(self, columns: Iterable[str] = ()) -> None:
        self.columns = frozenset(columns)

    def orders(self) -> Column:
        return F.sum(COUNTS) if COUNTS in self.columns else F.count(F.lit(1))

    def items(self, hit: Column | None = None) -> Column:
        counted = F.col(ITEMS) if hit is None else F.when(hit, F.col(ITEMS)).otherwise(0)
        return F.coalesce(F.sum(counted), F.lit(0))

    def gmv(self) -> Column:
        return F.sum(ORDER_VALUE)

    def mean(self, c: str | Column) -> Column:
        """Of what an order fixes, or of what the rollup keeps the totals of."""
        if isinstance(c, str) and f"{c}_sum" in self.columns:
            return F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))
        value = _column(c).cast("double")
        return F.try_divide(F.sum(value * F.col(ITEMS)), F.sum(F.when(value.isNotNull(), F.col(ITEMS))))


def grain_of(df: DataFrame) -> ItemGrain:
    return OrderGrain(df.columns) if ITEMS in df.columns else ItemGrain()
