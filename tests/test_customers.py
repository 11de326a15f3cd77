"""Customer numbers have no gaps, and unions of bitmaps count what a distinct count does, for every range of dates."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators.filters import ALL_ROWS, FilterSpec, apply_filters
from marketlens.plans import geo, rollups
from marketlens.plans.customers import BITS, CUSTOMER, NUMBER, customer_days, new_numbers, number_customers, unique_customers

START = datetime(2017, 1, 28)
SCHEMA = "order_id string, customer_unique_id string, customer_state string, order_purchase_timestamp timestamp, order_year_month date, items int"


def order(i, customer, state, ts):
    return (f"o{i}", customer, state, ts, ts.date().replace(day=1) if ts else None, 1)


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(3000):
        ts = START + timedelta(days=rnd.randrange(70), seconds=rnd.choice([0, 0, 1, 40_000, 86_399]))
        customer = None if i % 97 == 0 else f"c{rnd.randrange(1200)}"
        rows.append(order(i, customer, rnd.choice(["SP", "SP", "RJ", None]), None if i % 211 == 0 else ts))
    rows += [order(f"hot{i}", f"h{i}", "SP", START) for i in range(800)]  # a day with a large share
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def numbers(orders):
    return number_customers(orders)


@pytest.fixture(scope="module")
def days(orders, numbers):
    return customer_days(orders, numbers)


def test_numbers_have_no_gaps_and_follow_state_and_day(orders, numbers):
    found = {row[CUSTOMER]: row[NUMBER] for row in numbers.collect()}
    assert sorted(found.values()) == list(range(1, orders.select(CUSTOMER).dropna().distinct().count() + 1))
    hot = [n for customer, n in found.items() if customer.startswith("h")]
    assert max(hot) - min(hot) < len(hot) + 100  # side by side


RANGES = [
    ALL_ROWS,
    FilterSpec(),
    FilterSpec(date_from=date(2017, 2, 3), date_to=date(2017, 3, 9)),
    FilterSpec(date_from=date(2017, 2, 3), date_to=None),
    FilterSpec(date_from=None, date_to=date(2017, 2, 28)),
    FilterSpec(date_from=date(2017, 2, 10), date_to=date(2017, 2, 10)),  # only purchases at that midnight
    FilterSpec(date_from=date(2030, 1, 1), date_to=None),
    FilterSpec(date_from=None, date_to=date(2017, 3, 1), states=("SP",)),
]


@pytest.mark.parametrize("spec", RANGES)
@pytest.mark.parametrize("keys", [(), ("customer_state",), ("customer_state", "order_year_month")])
def test_counts(orders, days, spec, keys):
    count = F.count_distinct(CUSTOMER).alias("unique_customers")
    wanted = apply_filters(orders, spec).groupBy(*keys).agg(count).collect()
    found = unique_customers(days, spec, *keys).collect()
    # A group of customers without id has no bitmap.
    assert sorted(map(str, found)) == sorted(str(row) for row in wanted if row["unique_customers"] or not keys)


def test_conditions_that_bitmaps_do_not_know(days):
    for spec in (FilterSpec(statuses=("delivered",)), FilterSpec(min_value=5.0), FilterSpec(categories=("toys",)), FilterSpec(seller_states=("SP",))):
        with pytest.raises(ValueError):
            unique_customers(days, spec)


def test_new_customers_come_behind(spark, orders, numbers):
    known = numbers.where(F.col(NUMBER) <= 500)
    last = known.count()
    later = new_numbers(orders, known)
    found = [row[NUMBER] for row in later.collect()]
    assert sorted(found) == list(range(last + 1, numbers.count() + 1))
    assert later.join(known, CUSTOMER).count() == 0
    everyone = known.unionByName(later)
    total = unique_customers(customer_days(orders, everyone), ALL_ROWS).first()[0]
    assert total == numbers.count()
    assert new_numbers(orders, numbers).count() == 0


def test_numbers_beyond_one_bitmap(spark):
    day = "to_timestamp('2017-05-05 10:00:00')"
    many = spark.range(2 * BITS + 10).selectExpr(
        "concat('o', id) AS order_id", "concat('c', id) AS customer_unique_id", "'SP' AS customer_state", f"{day} AS order_purchase_timestamp",
        "DATE'2017-05-01' AS order_year_month", "1 AS items",
    )
    made = customer_days(many, number_customers(many))
    assert made.count() == 3 and unique_customers(made, ALL_ROWS).first()[0] == 2 * BITS + 10


def test_empty_table(spark, orders):
    none = orders.limit(0)
    numbers = number_customers(none)
    assert numbers.count() == 0 and unique_customers(customer_days(none, numbers), ALL_ROWS).first()[0] == 0


def test_pages_of_the_shop(spark, prepared, shop_orders):
    days = spark.read.parquet(f"{prepared[0]}/agg_customer_day.parquet")
    for spec in (ALL_ROWS, FilterSpec(), FilterSpec(date_from=date(2017, 2, 1), date_to=date(2018, 2, 1)), FilterSpec(statuses=("delivered",))):
        plain, counted = geo.state_metrics(shop_orders, spec), geo.state_metrics(shop_orders, spec, days)
        assert counted.select(plain.columns).exceptAll(plain).count() == 0 and plain.count() == counted.count()
    plain, counted = rollups.state_monthly(shop_orders), rollups.state_monthly(shop_orders, days)
    assert counted.select(plain.columns).exceptAll(plain).count() == 0 and plain.count() == counted.count()


def test_pages_read_no_customer_ids(spark, prepared, shop_orders):
    days = spark.read.parquet(f"{prepared[0]}/agg_customer_day.parquet")
    for df in (geo.state_metrics(shop_orders, FilterSpec(), days), rollups.state_monthly(shop_orders, days)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert CUSTOMER not in plan and "order_id" not in plan
        assert "PartitionFilters: [isnotnull(order_year_month" in plan or df.columns[1] == "order_year_month"
