"""Views, boundaries, states, stored tables."""

from __future__ import annotations

import json

import pytest

from marketlens import session
from marketlens.session import shared_dir, size_for, stage
from marketlens.sources import states, tables


def test_every_table_becomes_a_view(spark, prepared):
    names = tables.register_views(spark, prepared[0])
    assert "orders_enriched" in names and "agg_seller" in names
    lazily = tables.query(spark, "SELECT count(*) AS n FROM orders_enriched JOIN sellers USING (seller_id)")
    assert lazily.first()["n"] == 5
    assert tables.register_views(spark, prepared[0], ["sellers"]) == ["sellers"]


def test_writing_replaces(spark, tmp_path):
    tables.write_table(spark.range(3), str(tmp_path), "t")
    path = tables.write_table(spark.range(2), str(tmp_path) + "/", "t")
    assert spark.read.parquet(path).count() == 2


def test_states(spark):
    dim = states.states(spark)
    assert dim.count() == 27 == dim.select("uf").distinct().count() == dim.select("ibge_code").distinct().count()
    df = spark.createDataFrame([("SP",), ("??",), (None,)], "customer_state string")
    named = {r["customer_state"]: r["state_name"] for r in states.with_state_name(df).collect()}
    assert named == {"SP": "São Paulo", "??": "??", None: None}


def test_boundaries(spark, shop_csv):
    found = states.read_boundaries(spark, f"{shop_csv}/states.geojson")
    by_state = {r["uf"]: r for r in found.collect()}
    assert by_state["SP"]["state_name"] == "São Paulo"
    assert json.loads(by_state["RJ"]["geometry"])["coordinates"] == [[[1, 0.5], [1, 1.5], [2, 1.5], [1, 0.5]]]
    metrics = spark.createDataFrame([("SP", 1), ("AC", 2)], "customer_state string, orders int")
    joined = {r["customer_state"]: r["geometry"] is not None for r in states.with_boundary(metrics, found).collect()}
    assert joined == {"SP": True, "AC": False}


def test_codes_of_the_statistics_office(spark):
    coded = spark.createDataFrame([("35",), ("53",)], "codarea string")
    assert {r["uf"] for r in states.recode_ibge(coded).collect()} == {"SP", "DF"}


def test_staged_frames_lie_in_the_shared_folder(spark):
    staged = stage(spark.range(5).withColumnRenamed("id", "x"), "five")
    assert staged.count() == 5
    assert staged.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))


def test_a_fact_is_partitioned_by_month(spark, shop, tmp_path):
    path = str(tmp_path / "fact")
    back = tables.write_fact(shop, path, "seller_id")
    assert sorted(p.name for p in (tmp_path / "fact").glob("order_year_month=*")) == [
        "order_year_month=2017-01-01", "order_year_month=2017-03-01", "order_year_month=2018-09-01",
    ]
    assert sorted(map(str, back.select(shop.columns).collect())) == sorted(map(str, shop.collect()))


def test_sizes_follow_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    sizes = []
    try:
        for gigabytes in (0, 100, 100 * 1024):
            size_for(spark, gigabytes * 1024**3)
            sizes.append(int(spark.conf.get(key)))
    finally:
        spark.conf.unset(key)
    assert sizes == [4, 200, 204_800]


def test_a_session_is_sized_for_its_tables(spark, prepared, monkeypatch):
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 1024)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        session.build_session(tables=prepared[0])
        assert int(spark.conf.get(key)) == -(-session.stored_bytes(spark, prepared[0]) // 1024)
    finally:
        spark.conf.unset(key)


def test_staged_tables_are_discarded(spark):
    staged = stage(spark.range(3), "gone")
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    session.discard(staged)
    assert not tables.is_complete(spark, folder)


def test_an_unfinished_table_is_not_complete(spark, tmp_path):
    path = tables.write_table(spark.range(1), str(tmp_path), "t")
    assert tables.is_complete(spark, path)
    assert not tables.is_complete(spark, str(tmp_path / "other"))


def test_the_command_line(spark, shop_csv, tmp_path, monkeypatch, capsys):
    from marketlens.__main__ import main
    from marketlens.plans.job import QualityError

    monkeypatch.setattr("sys.argv", ["marketlens", shop_csv, str(tmp_path), "--late-share", "0.2", "0.6"])
    with pytest.raises(QualityError, match="distance_share"):
        main()
    assert "late_share" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/agg_seller.parquet").count() == 2
