"""The filter specification against a plain WHERE clause."""

from __future__ import annotations

from datetime import date
from itertools import product

import pytest

from marketlens.operators.filters import (
    ALL_ROWS,
    DATE_MAX,
    DATE_MIN,
    FilterSpec,
    all_options,
    apply_filters,
    options,
)

CONDITIONS = {
    "date_from": (date(2017, 1, 2), "order_purchase_timestamp >= TIMESTAMP_NTZ '2017-01-02 00:00:00'"),
    "date_to": (date(2018, 9, 3), "order_purchase_timestamp <= TIMESTAMP_NTZ '2018-09-03 00:00:00'"),
    "states": (["SP"], "customer_state = 'SP'"),
    "categories": (["books", "furniture"], "product_category_name_english IN ('books', 'furniture')"),
    "statuses": (["shipped", "processing"], "order_status IN ('shipped', 'processing')"),
    "min_value": (100.0, "total_item_value >= 100"),
}


def ids(df):
    return sorted((r["order_id"], r["order_item_id"]) for r in df.select("order_id", "order_item_id").collect())


@pytest.mark.parametrize("on", list(product([False, True], repeat=len(CONDITIONS))))
def test_all_combinations(spark, shop, on):
    chosen = [key for key, wanted in zip(CONDITIONS, on) if wanted]
    spec = FilterSpec.of({key: CONDITIONS[key][0] for key in chosen})
    where = " AND ".join(CONDITIONS[key][1] for key in chosen) or "true"
    assert ids(apply_filters(shop, spec)) == ids(shop.where(where))


def test_defaults():
    spec = FilterSpec()
    assert (spec.date_from, spec.date_to) == (DATE_MIN, DATE_MAX) == (date(2016, 9, 4), date(2018, 9, 3))
    assert (spec.states, spec.categories, spec.statuses, spec.min_value) == ((), (), (), 0.0)
    assert FilterSpec.of({}) == ALL_ROWS


def test_the_last_day_ends_at_midnight(shop):
    assert ("o3", 1) in ids(apply_filters(shop, FilterSpec()))  # 00:00:00
    assert ("o4", 1) not in ids(apply_filters(shop, FilterSpec()))  # 10:00:00


def test_empty_lists_and_zero_are_no_condition(shop):
    spec = FilterSpec.of({"states": [], "categories": [], "statuses": [], "min_value": 0})
    assert len(ids(apply_filters(shop, spec))) == 5


def test_values_with_quotes(spark, shop):
    hostile = "x' OR '1'='1"
    assert ids(apply_filters(shop, FilterSpec.of({"states": [hostile]}))) == []
    named = spark.createDataFrame([("D'Oeste",), ("Recife",)], "customer_state string")
    assert apply_filters(named, FilterSpec.of({"states": ["D'Oeste"]})).count() == 1


def test_seller_states(shop):
    assert ids(apply_filters(shop, FilterSpec.of({"seller_states": ["PE"]}))) == [("o1", 2), ("o3", 1)]


def test_drill_down_replaces_the_states(shop):
    spec = FilterSpec.of({"states": ["SP"], "min_value": 5.0}).for_state("RJ")
    assert ids(apply_filters(shop, spec)) == [("o2", 1)]


def test_least_value_is_compared_as_stored(spark):
    stored = spark.sql("SELECT CAST(50.3 AS FLOAT) AS total_item_value")
    assert apply_filters(stored, FilterSpec.of({"min_value": 50.3})).count() == 1


def test_options(shop):
    assert [r[0] for r in options(shop, "product_category_name_english").collect()] == ["books", "furniture"]
    assert [r[0] for r in options(shop, "order_status").collect()] == ["delivered", "processing", "shipped"]
    every = [tuple(r) for r in all_options(shop).collect()]
    assert ("seller_state", "PE") in every and ("customer_state", "SP") in every
    assert len(every) == len(set(every)) == 2 + 2 + 3 + 2
