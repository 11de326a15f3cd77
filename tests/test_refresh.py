"""Bringing some months up to date against preparing everything."""

from __future__ import annotations

import shutil
from datetime import date
from pathlib import Path

import pytest

from checks.compare import normalized
from marketlens.operators.filters import ALL_ROWS
from marketlens.plans import job
from marketlens.plans.customers import unique_customers
from marketlens.plans.slices import SLICES
from marketlens.sources import tables

PLAIN = ["orders_enriched", "agg_order", *SLICES]
MONTHLY = [*PLAIN, "agg_customer_day"]
TABLES = [*PLAIN, "agg_state_monthly", "agg_category", "agg_seller"]


def rows(spark, folder, name):
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    columns = sorted(df.columns)
    return normalized(columns, map(tuple, df.select(*columns).collect()))


def files(folder):
    """Data files of the tables by month, with their time of writing."""
    found = {}
    for name in MONTHLY:
        for path in Path(folder, f"{name}.parquet").rglob("part-*.parquet"):
            found[f"{name}/{path.parent.name}/{path.name}"] = path.stat().st_mtime_ns
    return found


def changed_shop(shop_csv, folder):
    """March 2017 has one more order, May 2017 its first; the only order of January became one of May."""
    shutil.copytree(shop_csv, folder)
    orders = Path(folder, "orders.csv")
    text = orders.read_text()
    assert "2017-01-01 10:00:00" in text
    orders.write_text(
        text.replace("2017-01-01 10:00:00", "2017-05-01 10:00:00")
        + "o6,c3,delivered,2017-03-09 00:00:00,2017-03-09 12:00:00,2017-03-10 00:00:00,2017-03-12 00:00:00,2017-03-11 00:00:00\n"
    )
    with Path(folder, "order_items.csv").open("a") as items:
        items.write("o6,1,p2,s2,2017-03-12 00:00:00,64.0,8.0\no6,2,p1,s1,2017-03-12 00:00:00,32.0,4.0\n")
    with Path(folder, "order_payments.csv").open("a") as payments:
        payments.write("o6,boleto,1,108.0\n")
    return str(folder)


@pytest.fixture(scope="module")
def refreshed(spark, shop_csv, tmp_path_factory):
    top = tmp_path_factory.mktemp("refresh")
    new = changed_shop(shop_csv, top / "csv")
    job.prepare(spark, shop_csv, str(top / "kept"))
    before = files(top / "kept")
    job.refresh(spark, new, str(top / "kept"), [date(2017, 1, 1), date(2017, 3, 20), date(2017, 5, 1)])
    job.prepare(spark, new, str(top / "whole"))
    return top, before, files(top / "kept")


@pytest.mark.parametrize("name", TABLES)
def test_equals_a_full_run(spark, refreshed, name):
    top = refreshed[0]
    assert rows(spark, top / "kept", name) == rows(spark, top / "whole", name)


def test_customers_after_a_refresh(spark, refreshed):
    """Their numbers may differ from those of a full run, what is counted may not."""
    kept, whole = (spark.read.parquet(f"{refreshed[0] / run}/agg_customer_day.parquet") for run in ("kept", "whole"))
    for keys in ((), ("customer_state",), ("customer_state", "order_year_month")):
        counted = [sorted(map(str, unique_customers(days, ALL_ROWS, *keys).collect())) for days in (kept, whole)]
        assert counted[0] == counted[1]
    numbers = spark.read.parquet(f"{refreshed[0] / 'kept'}/dim_customer.parquet")
    assert numbers.count() == numbers.select("customer_no").distinct().count() == numbers.select("customer_unique_id").distinct().count()


def test_histories_after_a_refresh(spark, refreshed):
    """In any order of a customer's days."""
    entries = [spark.read.parquet(f"{refreshed[0] / run}/agg_customer.parquet").selectExpr("customer_unique_id", "inline(history)") for run in ("kept", "whole")]
    assert sorted(map(str, entries[0].collect())) == sorted(map(str, entries[1].collect())) != []


def test_rewrites_only_the_months(refreshed):
    _, before, after = refreshed
    other = {name: time for name, time in before.items() if "=2018-" in name}
    assert other and other == {name: time for name, time in after.items() if "=2018-" in name}
    assert not any("=2017-01-01" in name for name in after)  # no order of January is left
    assert {name.split("/")[0] for name in set(after) - set(before) if "=2017-05-01" in name} == set(MONTHLY)


def test_a_failed_write_leaves_the_table(spark, prepared, tmp_path):
    shutil.copytree(f"{prepared[0]}/agg_order.parquet", tmp_path / "agg_order.parquet")
    path = str(tmp_path / "agg_order.parquet")
    before = spark.read.parquet(path)
    stored = before.collect()
    broken = before.selectExpr("* EXCEPT (items)", "IF(order_id = 'o4', bigint(raise_error('broken')), items) AS items")
    with pytest.raises(Exception, match="broken"):
        tables.replace_months(broken.select(*before.columns), path, [date(2018, 9, 1)])
    assert sorted(spark.read.parquet(path).collect(), key=str) == sorted(stored, key=str)


def test_nothing_stays_staged(spark, refreshed, shop_csv):
    from marketlens.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = sorted(folder.rglob("_SUCCESS"))
    job.refresh(spark, str(refreshed[0] / "csv"), str(refreshed[0] / "kept"), [date(2017, 3, 1)])
    assert sorted(folder.rglob("_SUCCESS")) == before
