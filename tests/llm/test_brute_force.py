"""The corpus queries against SQL or plain loops over the supplied tables."""

from __future__ import annotations

import os

import numpy as np
import pytest
import xxhash

from checks.compare import normalized, oracle_connection
from marketlens.llm import neighbours, sharding, simhash, toxicity
from marketlens.llm.catalog import QUERIES
from marketlens.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    want = oracle_connection(SF).execute(ORACLE[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    got = QUERIES[name](spark, SF)
    assert normalized(got.columns, [tuple(r) for r in got.collect()]) == normalized(columns, rows)


def test_fingerprints_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)  # so that buckets are split again, too
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    fps = []
    for text in docs["text"]:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    found = {row["doc_id"]: row for row in QUERIES["op8_simhash"](spark, SF).collect()}
    assert [found[i]["fingerprint"] for i in docs["doc_id"]] == [f"{fp:016x}" for fp in fps]
    labels, ids = components_by_loop(fps, 2), docs["doc_id"].tolist()
    least = {label: min(i for i, other in zip(ids, labels) if other == label) for label in labels}
    assert [found[i]["component_id"] for i in ids] == [least[label] for label in labels]
    kept = simhash.drop_near_copies(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def components_by_loop(fps, radius):
    label = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= radius] for i in range(len(fps))]
    while changed:
        least = [min(label[j] for j in near[i]) for i in range(len(fps))]
        changed, label = least != label, least
    return label


@pytest.mark.parametrize("bucket", [2, 1024])
def test_links_of_a_large_group(spark, monkeypatch, bucket):
    """Hundreds of fingerprints a few bits from one another, so every level of buckets is used."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    centre = int(rng.integers(0, 2**63))
    while len(fps) < 300:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {row["node"]: row["root"] for row in simhash.components(edges).collect()}
    mine, want = [roots.get(x, x) for x in signed], components_by_loop(fps, 2)
    assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_counters():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    fps[100:300] = fps[0] ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64)) ^ np.uint64(3)
    for radius in (0, 1, 2, 5, 17):
        got = simhash.near(fps, fps[90:130], simhash._planes(fps), radius)
        assert (got == (np.bitwise_count(fps[None, :] ^ fps[90:130, None]) <= radius)).all()


def test_neighbours_recall(spark):
    found = QUERIES["op7_hilbert_neighbours"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        scores = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        scores[q] = np.inf
        best = np.lexsort((ids, scores))[:10]
        mine = found[found["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], [scores[ids.tolist().index(i)] for i in mine["vec_id"]], atol=1e-12)
        hits, total = hits + len(set(ids[best]) & set(mine["vec_id"])), total + 10
    assert hits >= 0.9 * total


@pytest.mark.parametrize("reach", [1, 320])
def test_neighbours_are_exact_at_any_reach(spark, monkeypatch, reach):
    """Few curves and short windows leave most neighbours out, as a large table does."""
    monkeypatch.setattr(neighbours, "PACK", 64)
    vectors = np.random.default_rng(5).normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, lambda i: i % 100 == 0, curves=2, reach=reach).toPandas()
    for q in range(0, 1500, 100):
        scores = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        scores[q] = np.inf
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == np.argsort(scores)[:10].tolist()


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    keys = neighbours.hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(256))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_near_equal(spark):
    rows = QUERIES["op3_histogram_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])
    assert rows.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    bytes_ = rows.groupby("shard")["size"].sum()
    assert (bytes_ - rows["size"].sum() / sharding.SHARDS).abs().max() <= rows["size"].max() + rows["size"].sum() * sharding.TOLERANCE


def test_shards_of_a_large_group_of_copies(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    sizes = sharding.assign(docs, 10).groupBy("shard").count().toPandas()["count"]
    assert sizes.max() - sizes.min() < 40


def test_toxicity_of_held_out_rows(spark):
    folder = SF.replace("0.001", "0.01")
    scores = QUERIES["op5_toxicity"](spark, folder).where("held_out").toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = scores.merge(labels, on="doc_id")
    clean, toxic = both[both["toxic"] == 0]["score"].to_numpy(), both[both["toxic"] == 1]["score"].to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() + (toxic[:, None] == clean[None, :]).mean() / 2 > 0.8


def test_disguised_words(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = toxicity.language_model(docs)
    for disguised, plain in {"1d10t": "idiot", "l0s3r": "loser", "stuuupid": "stupid", "tr@sh": "trash", "m-o-r-o-n": "moron"}.items():
        assert toxicity.decode(disguised, model) == plain
    words = toxicity.restored_words("an i d i o t, stuuupid*** cl0wn", lambda word: toxicity.decode(word, model))
    assert {"idiot", "stupid", "clown"} <= words


def test_language_of_pages(spark):
    rows = QUERIES["op9_language_id"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/pages.parquet").toPandas(), on="page_id")
    path = rows["url"].str.extract(r"//[^/]+/([a-z]{2})/")[0]
    assert (rows["lang"] == path)[path.notna()].mean() > 0.95
