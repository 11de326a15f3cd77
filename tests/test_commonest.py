"""Commonest values against a loop, and the plans they make."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.operators.commonest import commonest
from marketlens.plans import etl

SCHEMA = "k string, a string, b string, x double"


def loop(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)

    def mode(values):
        counts = Counter(v for v in values if v is not None)
        return min(counts, key=lambda v: (-counts[v], v)) if counts else None

    found = {}
    for key, group in groups.items():
        known = [row[3] for row in group if row[3] is not None]
        found[key] = (mode(r[1] for r in group), mode(r[2] for r in group), sum(known) if known else None, max(known, default=None))
    return found


def some_rows():
    rnd = random.Random(5)
    rows = [
        (rnd.choice(["p", "q", "r", "", None]), rnd.choice(["x", "y", "ä", "", None]), rnd.choice("uvw"), rnd.choice([None, 0.5, 2.0]))
        for _ in range(3000)
    ]
    rows += [("hot", f"v{i % 700}", "u", 1.0) for i in range(4000)]  # many different values, the first ones tied
    return rows + [("none", None, None, None), ("tie", "b", "2", 1.0), ("tie", "a", "10", 1.0), ("tie", None, None, 1.0)] + [("tie", None, "2", None)]


@pytest.mark.parametrize("empty", [False, True])
def test_against_a_loop(spark, empty):
    rows = [] if empty else some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    two = commonest(df, "k", ["a", "b"], {"total": F.sum("x"), "most": F.max("x")}, {"most": F.max})
    assert two.columns == ["k", "a", "b", "total", "most"]
    found = two.collect()
    assert {r["k"]: tuple(r)[1:] for r in found} == loop(rows) and len(found) == len(loop(rows))
    one = {r["k"]: r["a"] for r in commonest(df, "k", ["a"]).collect()}
    assert one == {k: v[0] for k, v in loop(rows).items()}


def test_no_buffer_of_values(shop_raw):
    for df in (etl.geo_centroids(shop_raw["geolocation"]), etl.payment_summary(shop_raw["order_payments"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "partial_count" in plan


@pytest.fixture(scope="module")
def shop_raw(spark, prepared):
    return {name: spark.read.parquet(f"{prepared[0]}/{name}.parquet") for name in ("geolocation", "order_payments")}
