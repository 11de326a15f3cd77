"""What grows with the input must not be held by the driver."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm.mixing import mix
from marketlens.llm.toxicity import _fit


def test_the_fit_makes_its_rows_dense_in_parts():
    random, width = np.random.default_rng(1), 256
    rows = [np.unique(random.integers(0, width, random.integers(0, 6))) for _ in range(6000)]
    labels = np.array([random.random() < (0.8 if 3 in row else 0.3) for row in rows], np.float64)
    tracemalloc.start()
    bias, weights = _fit(rows, labels, width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(rows) * width * 4  # a table of all rows in single precision
    dense = np.zeros((len(rows), width + 1))
    dense[:, width] = 1
    for i, row in enumerate(rows):
        dense[i, row] = 1
    w = np.append(weights, bias)
    ridge = np.append(np.full(width, 0.3), 1e-6)
    gradient = dense.T @ (labels - 1 / (1 + np.exp(-(dense @ w)))) - ridge * w
    assert np.abs(gradient).max() < 1e-6


def test_slots_and_documents_are_not_broadcast(spark):
    rows = [(i, f"s{i % 3}", "a b c d e " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    _, mixed = mix(docs, F.col("doc_id"))
    assert mixed.count() == len(rows)
    mixed.collect()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[([^\]]*)\]", plan)
    wanted = [kind for kind, keys in joins if "rank" in keys or "place" in keys]
    assert wanted and set(wanted) == {"SortMergeJoin"}
