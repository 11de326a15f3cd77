"""Exact quantiles against the builtin and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import quantiles
from marketlens.operators.quantiles import box_statistics, exact_quantiles, medians

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def expected(values, prob):
    return float(np.quantile(np.array(values, dtype=float), prob))


def as_dict(df):
    return {(r["g"], r["measure"], r["prob"]): r["quantile"] for r in df.collect()}


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, accuracy, seed):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)  # 100: brackets are narrower than the groups
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        group = rng.choice(["hot"] * 7 + ["b", "c"])
        # a value may be common, missing, or far from all others
        x = rng.choice([None, 7.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1) * 1e6])
        rows.append((group, x, rng.randrange(5)))
    rows.append(("single", 4.25, 2))
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = as_dict(exact_quantiles(df, ["g"], ["x", "y"], PROBS))
    groups = {g for g, _, _ in rows}
    assert len(got) == len(groups) * 2 * len(PROBS)
    for g in groups:
        for measure, at in (("x", 1), ("y", 2)):
            values = [r[at] for r in rows if r[0] == g and r[at] is not None]
            for prob in PROBS:
                assert got[g, measure, prob] == pytest.approx(expected(values, prob), rel=1e-12, abs=1e-12)


def test_whole_frame_as_one_group(spark):
    df = spark.range(1, 102).select(F.col("id").alias("x"))
    rows = exact_quantiles(df, [], ["x"], [0.5, 0.25]).collect()
    assert {r["prob"]: r["quantile"] for r in rows} == {0.5: 51.0, 0.25: 26.0}


def test_medians_keep_groups_without_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 4.0, None), ("b", None, None), (None, 9.0, 1.0)], "g string, x double, y double"
    )
    rows = {r["g"]: (r["n"], r["median_x"], r["median_y"]) for r in medians(df, ["g"], ["x", "y"]).collect()}
    assert rows == {"a": (2, 2.5, None), "b": (1, None, None)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(df, ["g"], ["x"], [0.5]).count() == 0
    assert medians(df, ["g"], ["x"]).count() == 0


def test_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 10)] + [("b", None)], "g string, x double")
    (row,) = box_statistics(df, ["g"], ["x"]).collect()
    assert row.asDict() == {
        "g": "a", "measure": "x", "n": 5, "mean": 4.0, "min": 1.0, "max": 10.0, "q1": 2.0, "median": 3.0, "q3": 4.0,
    }


def test_only_values_inside_brackets_are_shuffled(spark, tmp_path):
    """Of 400,000 values any shuffle gets less than one in two hundred."""
    path = str(tmp_path / "values")
    spark.range(0, 400_000, 1, 4).selectExpr("id % 2 AS g", "rand(1) * rand(2) AS x", "id AS y").write.parquet(path)
    df = medians(spark.read.parquet(path), ["g"], ["x"])
    (one, two) = sorted(df.collect())
    values = spark.read.parquet(path).toPandas()
    for row in (one, two):
        assert row["median_x"] == float(np.quantile(values[values["g"] == row["g"]]["x"], 0.5)) and row["n"] == 200_000
    written = []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            written.append(metrics.apply("shuffleRecordsWritten").value())
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        else:
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert len(written) > 3 and max(written) < 2000


def test_weights(spark):
    """A row of the order rollup counts once for each item, also for the brackets."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.gauss(0, 1), rng.choice([1, 1, 1, 2, 40])) for _ in range(2000)]
    got = as_dict(exact_quantiles(spark.createDataFrame(rows, "g string, x double, items int"), ["g"], ["x"], PROBS))
    for g in "ab":
        values = [x for group, x, n in rows if group == g for _ in range(n)]
        for prob in PROBS:
            assert got[g, "x", prob] == pytest.approx(expected(values, prob), rel=1e-12, abs=1e-12)


def test_a_missed_bracket_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "REACH", -40)  # brackets of nothing
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    df = spark.range(0, 10_000).selectExpr("1 AS g", "double(id) AS x")
    with pytest.raises(Exception, match="outside its bracket"):
        exact_quantiles(df, ["g"], ["x"], [0.5]).collect()
