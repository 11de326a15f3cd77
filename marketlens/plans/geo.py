"""Revenue and orders by customer state and city."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.functions.measures import grain_of
from marketlens.operators.filters import FilterSpec, apply_filters
from marketlens.operators.ranking import ascending, descending, largest
from marketlens.operators.scaling import spatial_extent
from marketlens.plans.customers import answers, with_customers

METRICS = ("gmv", "order_count", "unique_customers", "avg_review_score")


def _checked(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric


def _metrics(rows: DataFrame, *keys: str, customers: bool = True) -> DataFrame:
    m = grain_of(rows)
    return rows.groupBy(*keys).agg(
        m.mean("customer_lat").alias("lat"),
        m.mean("customer_lng").alias("lng"),
        m.orders().alias("order_count"),
        *([m.customers().alias("unique_customers")] if customers else []),
        m.gmv().alias("gmv"),
        m.review().alias("avg_review_score"),
    )


def state_metrics(fact: DataFrame, spec: FilterSpec = FilterSpec(), days: DataFrame | None = None) -> DataFrame:
    """``days``, the stored bitmaps of customers, spare the distinct count where the conditions allow it."""
    rows = apply_filters(fact, spec)
    if days is None or not answers(spec):
        return _metrics(rows, "customer_state")
    return with_customers(_metrics(rows, "customer_state", customers=False), days, spec, "customer_state")


def city_metrics(fact: DataFrame, spec: FilterSpec, state: str) -> DataFrame:
    """The cities of one state; the state replaces those chosen in ``spec``."""
    return _metrics(apply_filters(fact, spec.for_state(state)), "customer_city", "customer_state")


def city_drilldown(fact: DataFrame, spec: FilterSpec, state: str, metric: str = "gmv") -> DataFrame:
    return city_metrics(fact, spec, state).orderBy(*descending(_checked(metric)), *ascending("customer_city"))


def ranked_states(
    fact: DataFrame, spec: FilterSpec = FilterSpec(), metric: str = "gmv", days: DataFrame | None = None
) -> DataFrame:
    """Every state with a value, largest first."""
    bars = state_metrics(fact, spec, days).select("customer_state", _checked(metric)).dropna()
    return bars.orderBy(*descending(metric), *ascending("customer_state"))


def ranked_cities(fact: DataFrame, spec: FilterSpec, state: str, metric: str = "gmv", n: int = 20) -> DataFrame:
    """The ``n`` cities with the largest value."""
    bars = city_metrics(fact, spec, state).select("customer_city", _checked(metric)).dropna()
    return largest(bars, n, metric, ["customer_city"])


def city_extent(fact: DataFrame, spec: FilterSpec, state: str) -> DataFrame:
    """Centre and span of a state's cities, for a map view."""
    return spatial_extent(city_metrics(fact, spec, state))
