"""Periodic runs against a scan of every lag."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import periodic


def runs_by_loop(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def texts_of(rng):
    for _ in range(int(rng.integers(1, 6))):
        n, kind = int(rng.integers(0, 400)), rng.integers(0, 4)
        if kind == 0:
            yield rng.integers(0, int(rng.integers(1, 4)), n)
        elif kind == 1:
            text = rng.integers(0, 50, n)
            for _ in range(3 if n > 30 else 0):
                a = int(rng.integers(0, n - 1))
                period, end = int(rng.integers(1, max(2, (n - a) // 3 + 1))), int(rng.integers(a, n))
                for i in range(a, end):
                    text[i] = text[a + (i - a) % period]
            yield text
        elif kind == 2:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            yield np.array(b[:n])
        else:
            inner = np.tile(rng.integers(0, 2, int(rng.integers(1, 12))), int(rng.integers(1, 9)))
            yield np.tile(np.concatenate([inner, rng.integers(0, 2, int(rng.integers(1, 4)))]), 30)[:n]


@pytest.mark.parametrize("seed", range(60))
def test_every_run_of_random_texts(seed):
    texts = [np.asarray(text, np.int64) for text in texts_of(np.random.default_rng(seed))]
    assert periodic.runs_of(texts) == [runs_by_loop(text.tolist()) for text in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=6), min_size=1, max_size=3), st.integers(1, 40), st.integers(0, 30))
def test_runs_of_repeated_units(units, times, head):
    text = [7] * head + [x for unit in units for _ in range(times) for x in unit]
    assert periodic.runs_of([np.array(text, np.int64)]) == [runs_by_loop(text)]


def test_a_long_period_is_found_by_minimizers_alone():
    text = np.tile(np.random.default_rng(2).integers(0, 2000, 5000), 4)
    assert all(not periodic.by_lag(text, lag) for lag in range(1, periodic.SHORT))
    assert periodic.runs_of([text]) == [[(0, 20000, 5000)]]


def test_hard_rows(spark, hard_docs):
    rows = periodic.find_runs(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    found = {row["doc_id"]: row for row in rows}
    for empty in (3, 4, 5):
        assert (found[empty]["n_words"], found[empty]["runs"], found[empty]["collapsed"]) == (0, [], "")
    assert found[6]["n_words"] == 39_000 and found[6]["runs"] == []
    assert periodic.find_runs(hard_docs.limit(0)).count() == 0
    odd = spark.createDataFrame(
        [(None, "na " * 30), (None, "x\tna\n" + "na " * 30 + "y"), (1, "a b " * 12), (1, "a b " * 11), (2, "do re mi " * 40_000)],
        "doc_id long, text string",
    )
    got = [(r["doc_id"], [tuple(run) for run in r["runs"]], r["collapsed"]) for r in periodic.find_runs(odd).collect()]
    assert got == [
        (None, [(0, 30, 1)], "na"), (None, [(1, 31, 1)], "x na y"), (1, [(0, 24, 2)], "a b"), (1, [], "a b " * 10 + "a b"),
        (2, [(0, 120_000, 3)], "do re mi"),
    ]


def test_planted_periods(spark, hard_docs):
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3] + [None]
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, text) for i in ids] + [(ids[0], ""), (ids[0], None)], "doc_id long, text string")
    rows = periodic.with_planted_runs(docs).collect()
    for row in rows[:3]:
        g = zlib.crc32(str(row["doc_id"]).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert row["text"].split(" ") == [f"w{i if i < a else a + (i - a) % p}" for i in range(100)]
    assert [row["text"] or "" for row in rows[3:]] == [text, "", ""]


def test_best_run_and_digests(spark, tmp_path):
    """Ties of length to period go to the smaller start; ids here plant nothing."""
    import zlib

    number = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10)
    text = "a " * 24 + "b " * 24 + "c d " * 24
    spark.createDataFrame([(number, text, 5)], "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    row = periodic.op11_periodic_runs(spark, str(tmp_path)).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (3, 0, 24, 1, 24_000)
    assert row["runs_sha256"] == hashlib.sha256(b"0,24,1\n24,24,1\n48,48,2\n").hexdigest()
    assert row["collapsed_sha256"] == hashlib.sha256(b"a b c d").hexdigest()
