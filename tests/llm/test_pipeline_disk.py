"""What the stages of the pipeline leave on disk."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from marketlens.session import shared_dir

TEXTS = ["one two three four five", "one two three four five", "six seven eight nine ten", "plain words about the weather", None, ""]


@pytest.fixture
def corpus(spark, tmp_path):
    docs = [(i, text, "en", f"s{i % 2}", len(text or "")) for i, text in enumerate(TEXTS * 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(len(docs))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", "six seven eight nine ten")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def staged(spark) -> set[str]:
    return {str(p.parent) for p in Path(shared_dir(spark).removeprefix("file:")).rglob("_SUCCESS")}


STEPS = [corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.mixing, corpus_pipeline.sharding]


def test_a_stage_drops_what_the_stage_before_has_staged(spark, corpus, tmp_path):
    docs, old = spark.read.parquet(f"{corpus}/documents.parquet"), set()
    for k, step in enumerate(STEPS):
        before = staged(spark)
        result = step(spark, docs, corpus)
        assert not old & staged(spark)  # gone with the first work of this stage
        path = str(tmp_path / f"out{k}")
        result.write.parquet(path)
        old = staged(spark) - before
        assert old  # the rows were staged, and the result still reads them
        docs = spark.read.parquet(path)


def test_stages_may_also_be_chained_unwritten(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    chained = corpus_pipeline.decontamination(spark, corpus_pipeline.near_dedup(spark, docs, corpus), corpus)
    corpus_pipeline.near_dedup(spark, docs, corpus).write.parquet(str(tmp_path / "kept"))
    apart = corpus_pipeline.decontamination(spark, spark.read.parquet(str(tmp_path / "kept")), f"{corpus}/")
    assert sorted(map(str, chained.collect())) == sorted(map(str, apart.collect()))
    assert chained.count()


def test_a_result_that_is_not_written_yet_stays_readable(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    first = corpus_pipeline.near_dedup(spark, docs, corpus)
    corpus_pipeline.mixing(spark, docs, corpus)  # of older documents
    assert first.count()
    last = corpus_pipeline.sharding(spark, docs, corpus)
    corpus_pipeline.run(spark, corpus)  # another run
    assert last.count() == len(TEXTS) * 4
