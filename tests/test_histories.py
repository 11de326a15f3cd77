"""Cohorts and repeat purchases from stored histories equal those from orders, for every range of dates; no id is shuffled."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators.filters import ALL_ROWS, FilterSpec
from marketlens.plans import cohorts
from marketlens.plans.customers import CUSTOMER
from marketlens.plans.histories import HISTORY, answers, customer_histories, merged_histories

START = datetime(2017, 1, 28)
SCHEMA = "order_id string, customer_unique_id string, customer_state string, order_purchase_timestamp timestamp, order_year_month date, items int"


def order(i, customer, state, ts):
    return (f"o{i}", customer, state, ts, ts.date().replace(day=1) if ts else None, 1)


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(3000):
        ts = START + timedelta(days=rnd.randrange(150), seconds=rnd.choice([0, 0, 1, 40_000, 86_399]))
        customer = None if i % 97 == 0 else f"c{rnd.randrange(900)}"
        rows.append(order(i, customer, rnd.choice(["SP", "SP", "RJ", None]), None if i % 211 == 0 else ts))
    rows += [order(f"hot{i}", "hot", "SP", START + timedelta(hours=i)) for i in range(1500)]
    rows.append(order("nowhen", "never", "SP", None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def stored(spark, orders, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("histories") / "agg_customer.parquet")
    customer_histories(orders).write.parquet(path)
    return spark.read.parquet(path)


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


SPECS = [
    ALL_ROWS,
    FilterSpec(),
    FilterSpec(date_from=date(2017, 2, 3), date_to=date(2017, 3, 9)),
    FilterSpec(date_from=date(2017, 2, 3), date_to=None),
    FilterSpec(date_from=None, date_to=date(2017, 2, 28)),
    FilterSpec(date_from=date(2017, 2, 10), date_to=date(2017, 2, 10)),  # only purchases at that midnight
    FilterSpec(date_from=date(2030, 1, 1), date_to=None),
    FilterSpec(date_from=date(2017, 2, 3), date_to=date(2017, 4, 1), states=("RJ",)),
    FilterSpec(date_from=None, date_to=None, states=("SP", "RJ")),
]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("page", [cohorts.activity, cohorts.retention, cohorts.repeat_kpis])
def test_equals_the_orders(orders, stored, page, spec):
    assert bag(page(stored, spec)) == bag(page(orders, spec))


def test_conditions_that_histories_do_not_know(stored):
    for spec in (FilterSpec(statuses=("delivered",)), FilterSpec(min_value=5.0), FilterSpec(categories=("toys",)), FilterSpec(seller_states=("SP",))):
        assert not answers(spec)
        for page in (cohorts.retention, cohorts.repeat_kpis):
            with pytest.raises(ValueError):
                page(stored, spec)


def test_a_row_per_customer_however_many_orders(orders, stored):
    assert stored.count() == orders.select(CUSTOMER).dropna().distinct().count()
    entries = stored.where(F.col(CUSTOMER) == "hot").select(F.inline(HISTORY))
    days = orders.where(F.col(CUSTOMER) == "hot").select(F.to_date("order_purchase_timestamp")).distinct().count()
    assert entries.agg(F.sum("orders")).first()[0] == 1500 and entries.count() <= 2 * days


def test_months_replaced(orders, stored):
    """Some orders of February go, new customers and orders come: as if all had been built anew."""
    month = [date(2017, 2, 1), date(2017, 9, 1)]
    inside = F.coalesce(F.col("order_year_month").isin(*month), F.lit(False))
    changed = orders.where(inside & (F.col(CUSTOMER) != "hot")).withColumn(
        CUSTOMER, F.when(F.crc32("order_id") % 3 == 0, F.concat(F.lit("new"), CUSTOMER)).otherwise(F.col(CUSTOMER))
    )
    whole = customer_histories(orders.where(~inside).unionByName(changed))
    ordered = [df.select(CUSTOMER, F.sort_array(HISTORY).alias(HISTORY)) for df in (merged_histories(stored, changed, month), whole)]
    assert bag(ordered[0]) == bag(ordered[1])
    assert merged_histories(stored, orders.limit(0), []).count() == stored.count()


def test_empty_table(orders):
    none = customer_histories(orders.limit(0))
    assert none.count() == 0 and cohorts.retention(none, ALL_ROWS).count() == 0
    assert cohorts.repeat_kpis(none, ALL_ROWS).first()["customers"] == 0


def test_no_id_is_read_or_shuffled(stored):
    for df in (cohorts.retention(stored, SPECS[2]), cohorts.repeat_kpis(stored, SPECS[2])):
        assert CUSTOMER not in df._jdf.queryExecution().executedPlan().toString()


def test_the_shop(spark, prepared, shop_orders):
    kept = spark.read.parquet(f"{prepared[0]}/agg_customer.parquet")
    for spec in (ALL_ROWS, FilterSpec()):
        assert bag(cohorts.retention(kept, spec)) == bag(cohorts.retention(shop_orders, spec))
        assert bag(cohorts.repeat_kpis(kept, spec)) == bag(cohorts.repeat_kpis(shop_orders, spec))
