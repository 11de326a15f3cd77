"""What a query builds before it reads, and how large its tasks may get."""

from __future__ import annotations

import pytest

from checks import testdata
from checks.catalog import QUERIES
from marketlens.plans import etl, rollups, slices
from marketlens.session import JOIN_BYTES, RUNTIME_CONF, size_for
from marketlens.sources import tables

ON_ORDERS = ["installment_order_level", "overview_kpis_default", "geo_state_metrics", "geo_state_metrics_window"]
ON_ROUTES = ["flow_matrix", "flow_matrix_wide", "flow_kpis"]
ON_CATEGORIES = ["category_flags", "category_kpis", "category_quadrants", "rollup_category"]
ON_SELLERS = ["seller_worst5", "seller_spotlight", "seller_leaderboard", "scaled_marks_seller", "rollup_seller"]


@pytest.fixture
def source(spark, tmp_path):
    """Seven items of three orders; an order and a product come twice, one item has no product."""

    def put(name: str, schema: str, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = "cast('1996-02-1%d' as timestamp)"
    put("nation", "n_nationkey int, n_name string", [(0, "a")])
    put("customer", "c_custkey long, c_mktsegment string", [(1, "FURNITURE"), (2, "MACHINERY")])
    put("supplier", "s_suppkey long, s_name string", [(1, "s1"), (2, "s2"), (3, None)])
    put("part", "p_partkey long, p_type string, p_size int", [(1, "LARGE", 1), (1, "LARGE", 1), (2, "SMALL", 0)])
    spark.createDataFrame(
        [(1, 1, "F", 10.0, "1-URGENT"), (1, 1, "F", 10.0, "1-URGENT"), (2, 2, "O", 20.0, "3-MEDIUM"), (4, 1, "P", None, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    ).selectExpr("*", f"{day % 0} AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1, 1), (1, 2, 2), (1, 2, 1), (2, 1, 2), (2, 3, 2), (4, 2, 3), (4, 9, 1)]
    spark.createDataFrame(
        [(o, p, s, n, 100.0 * n, 0.05) for n, (o, p, s) in enumerate(items, 1)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_tax double",
    ).selectExpr("*", f"{day % 2} AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def built(monkeypatch, spark, sf_dir: str, name: str) -> set[str]:
    """Tables that a query builds in a session that has none yet."""
    monkeypatch.setattr(testdata, "_built", {})
    monkeypatch.setattr(testdata, "_opened", {})
    QUERIES[name](spark, sf_dir).collect()
    return {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in testdata._built.values()}


@pytest.mark.parametrize("name", [*ON_ORDERS, *ON_ROUTES, *ON_CATEGORIES, *ON_SELLERS])
def test_a_page_on_a_rollup_does_not_build_the_fact(spark, source, monkeypatch, name):
    assert "orders_enriched" not in built(monkeypatch, spark, source, name)


def test_centroids_are_made_once_for_the_fact(spark, source, monkeypatch):
    calls = []
    made = testdata.geo_centroids
    monkeypatch.setattr(testdata, "geo_centroids", lambda points: calls.append(1) or made(points))
    assert built(monkeypatch, spark, source, "filter_seller_state") == {"geo_centroids", "order_side", "orders_enriched"}
    assert len(calls) == 1


def as_sets(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", ["agg_order", *slices.SLICES])
def test_rollups_of_joined_items_are_those_of_the_stored_fact(spark, source, name):
    fact, side = testdata.fact(spark, source), testdata._stored(testdata.build_order_side, spark, source)
    wanted = rollups.by_order(fact, etl.order_measures(side)) if name == "agg_order" else slices.SLICES[name](fact)
    assert as_sets(testdata.table(spark, source, name)) == as_sets(wanted)


@pytest.mark.parametrize("name", list(slices.SLICES))
def test_a_slice_of_joined_items_is_shuffled_by_order_once(spark, source, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = slices.SLICES[name](testdata._joined_items(spark, source))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("SortMergeJoin [order_id")]
    assert "Exchange" not in above
    assert "shipping_limit_date" not in plan and "customer_unique_id" not in plan


def test_items_that_miss_the_condition_still_need_the_fact(spark, source, monkeypatch):
    assert "orders_enriched" in built(monkeypatch, spark, source, "overview_kpis_filtered")


def test_a_task_reads_little_enough_to_be_sorted_in_memory():
    size = RUNTIME_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    assert int(size.removesuffix("m")) * 7 <= 512


def test_shuffles_of_the_fact_start_with_more_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        size_for(spark, 100 * 1024**3, JOIN_BYTES)
        assert int(spark.conf.get(key)) == 6400
    finally:
        spark.conf.unset(key)


def test_what_an_order_fixes_goes_first_in_the_shuffle_of_the_fact(spark, source):
    raw, side = testdata.raw_tables(spark, source), testdata._stored(testdata.build_order_side, spark, source)
    fact = etl.balanced_fact(raw, testdata._stored(testdata.build_centroids, spark, source), side)
    plan = fact._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RebalancePartitions":
        plan = plan.children().head()
    names = [plan.output().apply(i).name() for i in range(plan.output().size())]
    last = max(names.index(c) for c in names if c in side.columns or c == tables.MONTH_KEY)
    assert last < min(names.index(c) for c in names if c in ("price", "seller_id", "product_id", "seller_lat"))


def initial_plan(spark, source: str, name: str, limit: str) -> str:
    """How a slice is planned before it runs, in a session that has the tables it joins."""
    testdata.table(spark, source, name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        return slices.SLICES[name](testdata._joined_items(spark, source))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(slices.SLICES))
def test_items_are_not_shuffled_by_seller_for_a_small_table(spark, source, name):
    # A limit far above the size of the sellers and below the product of it and that of the zip codes.
    plan = initial_plan(spark, source, name, "65536")
    assert "BroadcastHashJoin [seller_id" in plan and "SortMergeJoin [seller_id" not in plan
