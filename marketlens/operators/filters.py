"""The filter specification shared by every page."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.measures import ITEMS
from marketlens.sources.tables import MONTH_KEY

# The default date range.
DATE_MIN = date(2016, 9, 4)
DATE_MAX = date(2018, 9, 3)


@dataclass(frozen=True)
class FilterSpec:
    """Conditions on the fact, all of which must hold; empty or zero means none.

    ``date_to`` counts as its midnight, so later that day is outside.
    """

    date_from: date | None = DATE_MIN
    date_to: date | None = DATE_MAX
    states: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    min_value: float = 0.0
    seller_states: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: Mapping) -> FilterSpec:
        """From a dict; an absent key sets no condition."""
        return cls(
            date_from=values.get("date_from"),
            date_to=values.get("date_to"),
            states=tuple(values.get("states") or ()),
            categories=tuple(values.get("categories") or ()),
            statuses=tuple(values.get("statuses") or ()),
            min_value=values.get("min_value") or 0.0,
            seller_states=tuple(values.get("seller_states") or ()),
        )

    def for_state(self, state: str) -> FilterSpec:
        """Drill down: this state in place of the chosen ones."""
        return replace(self, states=(state,))

    @property
    def looks_at_items(self) -> bool:
        """Whether items of one order may differ in meeting the conditions."""
        return bool(self.item_columns()) or self.least_value is not None

    @property
    def least_value(self) -> float | None:
        return float(self.min_value) if self.min_value and self.min_value > 0 else None

    def item_columns(self) -> set[str]:
        """Columns with a list of values in which items of one order may differ."""
        listed = {"product_category_name_english": self.categories, "seller_state": self.seller_states}
        return {name for name, values in listed.items() if values}

    def without_dates(self) -> FilterSpec:
        return replace(self, date_from=None, date_to=None)


ALL_ROWS = FilterSpec(date_from=None, date_to=None)


def in_date_range(spec: FilterSpec, ts: str = "order_purchase_timestamp") -> list[Column]:
    conditions = []
    if spec.date_from:
        conditions.append(F.col(ts) >= F.lit(spec.date_from))
    if spec.date_to:
        conditions.append(F.col(ts) <= F.lit(spec.date_to))
    return conditions


def _month_range(spec: FilterSpec) -> list[Column]:
    """Implied by the date range; prunes month folders, which a timestamp range cannot."""
    conditions = []
    if spec.date_from:
        conditions.append(F.col(MONTH_KEY) >= F.lit(spec.date_from.replace(day=1)))
    if spec.date_to:
        conditions.append(F.col(MONTH_KEY) <= F.lit(spec.date_to.replace(day=1)))
    return conditions


def apply_filters(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows of the fact, or of its order rollup, that meet the specification.

    Values are literals of the expression tree, so quotes in them are harmless.
    """
    if ITEMS in fact.columns and not (spec.item_columns() <= set(fact.columns) and spec.least_value is None):
        raise ValueError("conditions on items need the fact, not its order rollup")
    conditions = in_date_range(spec)
    if MONTH_KEY in fact.columns:
        conditions += _month_range(spec)
    memberships = {
        "customer_state": spec.states,
        "product_category_name_english": spec.categories,
        "order_status": spec.statuses,
        "seller_state": spec.seller_states,
    }
    conditions += [F.col(name).isin(*values) for name, values in memberships.items() if values]
    if spec.least_value is not None:
        # Compared in the column's own type, so the scan can use it.
        value_type = fact.schema["total_item_value"].dataType
        conditions.append(F.col("total_item_value") >= F.lit(spec.least_value).cast(value_type))
    for condition in conditions:
        fact = fact.where(condition)
    return fact


def coarsest(fact: DataFrame, orders: DataFrame, spec: FilterSpec) -> DataFrame:
    """The order rollup where the conditions allow it, else the fact."""
    return fact if spec.looks_at_items else orders


FACT = "orders_enriched"
# Stored rollups from the coarsest to the finest, with the columns whose values they keep apart within an order.
KEPT_APART = {
    "agg_order": set(),
    "agg_order_route": {"seller_state"},
    "agg_order_category": {"product_category_name_english"},
    "agg_order_seller": {"seller_id", "seller_city", "seller_state"},
}


def pick(spec: FilterSpec, *groups: str) -> str:
    """Name of the coarsest stored table for a page that groups by ``groups``, columns items of an order may differ in.

    A condition on such a column must be on one the page groups by: otherwise an order may meet it in several rows
    and would count in each. Then, and for a least item value, only the fact will do.
    """
    if spec.least_value is None and spec.item_columns() <= set(groups):
        for name, kept in KEPT_APART.items():
            if set(groups) <= kept:
                return name
    return FACT


def options(fact: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column to choose from, in order."""
    return fact.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


OPTION_COLUMNS = ["customer_state", "product_category_name_english", "order_status", "seller_state"]


def all_options(fact: DataFrame, columns: list[str] = OPTION_COLUMNS) -> DataFrame:
    """The choices of several filters in one pass: ``filter``, ``option``."""
    long = fact.select(*columns).unpivot([], columns, "filter", "option")
    return long.where(F.col("option").isNotNull()).distinct().orderBy("filter", "option")
