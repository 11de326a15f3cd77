"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, clashing names, empty tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from marketlens.llm import chat, decontaminate, langid, mixing, neighbours, sharding, simhash, suffix_dedup, toxicity, warc


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


def test_repeats(hard_docs):
    rows = suffix_dedup.remove_repeats(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    found = {row["doc_id"]: row for row in rows}
    assert found[1]["n_removed"] == 0 and found[2]["n_spans"] == 1 and found[2]["n_removed"] > 80
    assert found[None]["n_removed"] == 0  # neither smaller nor larger than others
    assert found[3]["n_bytes"] == 0 and found[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[6]["n_removed"] == 0 and found[7]["n_bytes"] - found[7]["n_removed"] < 50
    assert found[12]["n_removed"] == 200 and found[11]["n_removed"] == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [
            (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n", 0), (1, 0, "user", None, 0), (2, 0, "user", "", 0),
            (3, 0, None, "who", 0), (3, None, "a\nb<|nl|>", r"<\|x <s> <\\s>", 0), (None, 0, "system", "s", 0),
            (4, 0, "user", "same", 0), (4, 0, "user", "same", 0), (5, 0, "user", "long " * 100_000, 0), (5, 1, "assistant", "ok", 0),
        ],
        "conv_id long, turn long, role string, text string, formatted int",
    )
    found = by_id(chat.read_back(chat.format_chats(turns)), "conv_id")
    assert [tuple(t) for t in found[1]["turns"]] == [("user", ""), ("assistant", "<|im_end|>\n<|im_start|>user\n")]
    assert found[1]["valid"] and found[1]["loss_text"] == "<|im_end|>\n<|im_start|>user\n"
    assert not found[2]["valid"] and found[2]["bad_turn"] == -1  # ends before the assistant's turn
    assert [tuple(t) for t in found[3]["turns"]] == [("a\nb<|nl|>", r"<\|x <s> <\\s>"), ("", "who")]
    assert found[None]["turns"][0]["text"] == "s" and len(found[4]["turns"]) == 2 and found[4]["bad_turn"] == 1
    assert found[5]["valid"] and len(found[5]["turns"][0]["text"]) == 500_000
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_shards(hard_docs):
    found = sharding.assign(hard_docs, shards=3)
    assert sorted(found.columns) == sorted([*hard_docs.columns, "slot"])  # shard takes the place of the input's
    rows = found.collect()
    assert len(rows) == hard_docs.count()
    for shard in {row["shard"] for row in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert len({row["shard"] for row in rows if row["doc_id"] == 2}) == 1  # equal keys stay together


@pytest.mark.parametrize("rows", [0, 500_000])
def test_decontamination(hard_docs, hard_items, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    found = by_id(decontaminate.find_hits(hard_docs, hard_items))
    assert found[1]["items"] == ["1"] and found[2]["items"] == ["1", "4"]  # a null id is not listed
    assert found[None]["items"] == ["1"] and found[3]["n_words"] == 0 and not found[6]["hits"]
    kept = decontaminate.decontaminate(hard_docs, hard_items)
    assert kept.columns == hard_docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10, 11, 12}
    assert decontaminate.decontaminate(hard_docs, hard_items.limit(0)).count() == hard_docs.count()


def test_words_below_a_window(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, "three two")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Two, THREE")], "item_id long, text string")
    found = by_id(decontaminate.find_hits(docs, items))
    assert [bool(found[i]["hits"]) for i in (1, 2, 3)] == [True, True, False]


def test_toxicity(hard_docs, hard_labels):
    scorer = toxicity.train(hard_docs, hard_labels)
    rows = toxicity.score(hard_docs, scorer).collect()
    assert len(rows) == hard_docs.count() and all(0 <= row["score"] <= 1 for row in rows)
    kept = toxicity.drop_toxic(hard_docs, hard_labels)
    assert kept.columns == hard_docs.columns
    unlabelled = toxicity.train(hard_docs, hard_labels.limit(0))
    assert unlabelled.weights == {} and len(toxicity.score(hard_docs, unlabelled).collect()) == hard_docs.count()


def test_mix(hard_docs):
    plan, mixed = mixing.mix(hard_docs, F.monotonically_increasing_id())
    rows = mixed.collect()
    assert len(rows) == hard_docs.count()
    assert all(row["taken"] <= 2 * row["size"] for row in rows)
    assert [r["source"] for r in plan.orderBy("sid").collect()] == ["", "a", "b", "c", None]
    assert mixing.mixed_documents(hard_docs).columns == hard_docs.columns


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 120)]
    odd = [(0, None), (200, []), (300, [0.0, 0.0, 0.0]), (400, [nan, 1.0, 1.0]), (500, [inf, 1.0, 1.0]), (600, [None, 1.0, 1.0]),
           (700, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (100, [2.0, 0.0, 1.0])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    rows = neighbours.nearest(table, lambda i: i % 100 == 0).collect()
    assert {row["query_id"] for row in rows} == {100} and len(rows) == 10
    best = sorted(rows, key=lambda r: r["rank"])
    # 30, 65: the same vector as 100; ties go to the smaller id.
    assert [r["vec_id"] for r in best][:2] == [30, 65] and best[0]["score"] == 0.0
    assert [(r["score"], r["vec_id"]) for r in best] == sorted((r["score"], r["vec_id"]) for r in best)
    assert neighbours.nearest(table.where("vec_id is null"), lambda i: i % 100 == 0).count() == 0
    few = neighbours.nearest(table.where("vec_id IN (100, 5)"), lambda i: i % 100 == 0).collect()
    assert [r["vec_id"] for r in few] == [5]


def test_fingerprints(hard_docs):
    found = {row["doc_id"]: row for row in simhash.near_duplicates(hard_docs).collect()}
    assert found[3]["fp"] == found[4]["fp"] == found[5]["fp"] == 0 and found[5]["component_id"] == 3
    assert found[12]["component_id"] == 11
    kept = simhash.drop_near_copies(hard_docs)
    ids = [row["doc_id"] for row in kept.collect()]
    assert kept.columns == hard_docs.columns
    assert ids.count(9) == 1 and ids.count(2) == 1 and {1, 3, 6, 11} <= set(ids) and not {4, 5, 7, 12} & set(ids)
    assert simhash.near_duplicates(hard_docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows are dropped each on its own, whether they have no id or one that others have, too."""
    text = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abcd"}
    copies = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (None, text["a"]), (None, text["c"]), (None, text["c"] + " "), (None, text["d"])]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"].strip()) for r in simhash.drop_near_copies(docs).collect())
    assert kept == [(0, text["c"]), (0, text["d"]), (1, text["a"]), (2, text["b"])]
    items = spark.createDataFrame([(1, text["a"])], "item_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"].strip()) for r in decontaminate.decontaminate(docs, items).collect())
    assert kept == [(0, text["c"]), (0, text["c"]), (0, text["d"]), (2, text["b"])]


def test_languages(spark, hard_docs):
    models = langid.train(hard_docs)
    pages = spark.createDataFrame(
        [
            (1, "http://a.b.fr/x", "<html lang='FR'><body>ünïcödé</body></html>"), (2, None, None), (3, "no url", ""),
            (3, "http://a.b.fr/x", "<p>word of a very long text"), (None, "http://[bad", "<html>"), (4, "http://a.b.fr", "x " * 100_000),
        ],
        "page_id long, url string, html string",
    )
    rows = langid.identify(pages, models).collect()
    assert len(rows) == 6 and all(0 <= row["probability"] <= 1.0000001 for row in rows)
    assert {row["declared"] for row in rows} == {"", "fr"}
    assert langid.identify(pages, {}).where("lang IS NULL").count() == 6
    assert langid.identify(pages.limit(0), models).count() == 0


def test_archives(spark, tmp_path):
    same = "<html>" + "payload " * 20
    pages = spark.createDataFrame(
        [(3, "http://x/ \r\nWARC/1.1", same), (1, None, same), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "n", same),
         (7, "w", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" * 9), (1, None, same)],
        "page_id long, url string, html string",
    )
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write_archives(pages, path, compression)
        rows = warc.read_archives(spark, path).collect()
        assert len(rows) == 8 and all(row["gap"] is None for row in rows)
        kinds = sorted((row["record_id"], row["record_type"], row["refers_to"]) for row in rows)
        assert ("<urn:x-page:3>", "revisit", "<urn:x-page:1>") in kinds
        assert sum(kind == "revisit" for _, kind, _ in kinds) == 1
    warc.write_archives(pages.limit(0), f"{tmp_path}/empty")
    assert warc.read_archives(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, hard_docs, hard_labels, hard_items, tmp_path_factory, name, stage):
    folder = str(tmp_path_factory.mktemp(name))
    hard_labels.write.parquet(f"{folder}/labels.parquet")
    hard_items.write.parquet(f"{folder}/benchmark.parquet")
    found = stage(spark, hard_docs, folder)
    assert set(hard_docs.columns) <= set(found.columns) and found.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.schema.simpleString() == hard_docs.schema.simpleString()
    assert stage(spark, hard_docs.where(F.lit(False)), folder).count() == 0
