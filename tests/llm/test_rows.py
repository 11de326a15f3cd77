"""Rows that share an id or have none are documents of their own."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, mixing, sharding
from marketlens.llm.catalog import QUERIES

ITEM = " ".join(f"item{i}" for i in range(12))
SCHEMA = "doc_id long, text string, source string, lang string"


def folder(spark, tmp_path, rows):
    for part in range(2):  # two files, so that places in a file repeat
        spark.createDataFrame(rows[part::2], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def hit_words(text):
    words, window = re.findall("[a-z0-9]+", (text or "").lower()), 10
    item = ITEM.split()
    hit = set()
    for start in range(len(words) - window + 1):
        if any(words[start : start + window] == item[i : i + window] for i in range(len(item) - window + 1)):
            hit.update(range(start, start + window))
    return len(words), len(hit)


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_leaks_by_row(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rows = [(None, f"{ITEM} tail", "a", "en"), (None, "clean text", "a", "en"), (None, "clean text", "a", "en"), (None, None, "a", "en"),
            (7, f"head {ITEM}", "b", "en"), (7, "clean " * 30, "b", "en"), (8, "", "b", "en"), (None, f"{ITEM} tail", None, "en")]
    found = QUERIES["op4_decontamination"](spark, folder(spark, tmp_path, rows)).collect()
    key = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in found), key=key) == sorted(((r[0], *hit_words(r[1])) for r in rows), key=key)
    assert all(r["n_items"] == (r["n_hit"] > 0) == r["contaminated"] for r in found)


def test_shards_of_copies_without_ids(spark, tmp_path):
    rows = [(None, "a copied text", "a", "en")] * 1000 + [(5, "a text and id that repeat", "a", "en")] * 500 + [(i, f"text {i}", "a", "en") for i in range(900)]
    path = folder(spark, tmp_path, rows)
    found = QUERIES["op3_histogram_sharding"](spark, path).toPandas()
    assert len(found) == len(rows)
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == sharding.SHARDS and (sizes - found["size"].sum() / sharding.SHARDS).abs().max() <= 100
    assert found.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    staged = sharding.assign(spark.read.parquet(f"{path}/documents.parquet"), 10).toPandas()
    sizes = (staged["text"].str.len() + sharding.ROW_BYTES).groupby(staged["shard"]).sum()
    assert len(staged) == len(rows) and len(sizes) == 10 and sizes.max() - sizes.min() <= 150
    assert (staged["doc_id"].isna()).sum() == 1000


def test_mix_of_rows_without_ids(spark, tmp_path):
    rows = [(None, " ".join(["w"] * 20), s, "en") for s in "abc" for _ in range(200)] + [(1, "one id", "a", "en"), (1, "one id", "a", "en")]
    docs = spark.read.parquet(f"{folder(spark, tmp_path, rows)}/documents.parquet")
    plan, mixed = mixing.mix(docs, F.monotonically_increasing_id())
    mixed = mixed.toPandas()
    assert len(mixed) == len(rows) and mixed["row"].is_unique
    kept = mixing.mixed_documents(docs).toPandas()
    # Each row comes as often as is taken of it.
    words = kept["text"].str.split().str.len().groupby(kept["source"]).sum()
    wanted = (mixed["size"] * (mixed["taken"] / mixed["size"]).round()).groupby(mixed["source"]).sum()
    assert words.to_dict() == wanted[wanted > 0].to_dict()
    for row in plan.collect():
        assert abs(words[row["source"]] - row["target"]) <= 0.1 * row["target"] + mixing.BLOCK
