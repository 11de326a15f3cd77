"""Benchmark decontamination: a prefix-filtered set join.

Benchmark items are cut into windows of ten words (an item of fewer words is one window).
The tokens of a window are its shingles of five words. Shingles are counted over all
documents, and every window is indexed under its rarest shingle: as a window must be
contained whole, that one token is the prefix any match has to share. Document shingles
probe the index; positional and length bounds discard candidates whose window would begin
before or end after the document, and the words are then compared one by one.

Document words don't move between tasks: shingles probe a broadcast index while it has at most
``BROADCAST_ROWS`` rows; to a larger one only their hashes and places are shuffled.

Cases. A null text has no words, nor has one of separators only; such an item has no
windows and such a document no hits. Rows that share a doc_id, or have none, are documents of
their own (``find_hits`` itself takes rows of one doc_id for one document). Repeated items
count once; an item_id with several texts has the windows of all. A null item_id matches
like any other and is left out of the list of ids. Empty tables give no rows, or no hits.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import hex_sha256, packed, read, release, stage, stored_row, text_or_empty

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 500_000  # of some 200 bytes each
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(pieces, lambda w: w != "")


def shingle_at(array: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from ``at`` on; past the end words are null."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(length)])


def _windows(items: DataFrame) -> DataFrame:
    """Distinct windows: words, length, and the id of each (``window``)."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    return (
        cut.select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start") + 1, F.lit(WINDOW)).alias("window"))
        .distinct()
    )


def _probes(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per document and token, and one without token (``at`` -1) per document."""
    at = F.col("at")
    positions = F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.size("words") - 1))
    rows = docs.select(
        "doc_id", "words", F.explode(F.when(F.size("words") > 0, positions).otherwise(F.array(F.lit(-1)))).alias("at")
    )
    if lengths == [SHINGLE]:
        return rows.withColumn("token", F.when(at >= 0, shingle_at(F.col("words"), at, SHINGLE)))
    tokens = F.array(*[shingle_at(F.col("words"), at, n) for n in lengths])
    return rows.select("*", F.explode(F.when(at >= 0, tokens).otherwise(F.array(F.lit(None).cast("long")))).alias("token"))


def _probed(cut: DataFrame, lengths: list[int], index: DataFrame) -> DataFrame:
    """Candidates: doc_id, words, at, and the index entry of the token there; one row per document has none.

    A small index is broadcast and the words stay where they are. To a larger one only tokens and
    places travel, and the candidates are joined back to their document.
    """
    entry = F.struct("offset", "length", "window").alias("entry")
    if index.count() <= BROADCAST_ROWS:
        entries = index.groupBy("token").agg(F.collect_list(entry).alias("entries"))
        probed = _probes(cut, lengths).join(F.broadcast(entries), "token", "left").where("at < 0 OR entries IS NOT NULL")
        return probed.select("doc_id", "words", "at", F.explode_outer("entries").alias("entry"))
    pairs = _probes(cut, lengths).where("at >= 0").select("doc_id", "at", "token").join(index, "token")
    found = pairs.select(F.col("doc_id").alias("of"), "at", entry).distinct()
    candidates = cut.join(found, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "words", "at", "entry")
    kind = dict(candidates.dtypes)["entry"]
    return candidates.unionByName(cut.select("doc_id", "words", F.lit(-1).alias("at"), F.lit(None).cast(kind).alias("entry")))


def find_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, starts of matched windows with their lengths, item ids."""
    windows = stage(_windows(items), "windows")
    size = F.size("window")
    parts = stage(
        windows.select("window").distinct().select(
            "window",
            F.explode(F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0)))).alias("offset"),
            F.least(size, F.lit(SHINGLE)).alias("length"),
        ).select(
            "window", "offset", "length",
            F.expr("xxhash64(" + ", ".join(f"CASE WHEN {i} < length THEN get(window, offset + {i}) END" for i in range(SHINGLE)) + ")").alias("token"),
        ),
        "window-tokens",
    )
    lengths = sorted({SHINGLE, *[row[0] for row in parts.select("length").distinct().collect()]})
    wanted = parts.select("token").distinct()
    cut = docs.select("doc_id", words(F.col("text")).alias("words"))

    # A null word never equals one of a window, so tokens of shorter lengths hash as many words as they have.
    counted = (
        _probes(cut, lengths).select("token")
        .join(F.broadcast(wanted) if parts.count() <= BROADCAST_ROWS else wanted, "token")
        .groupBy("token")
        .agg(F.count("*").alias("frequency"))
    )
    rarest = Window.partitionBy("window").orderBy("frequency", "token", "offset")
    index = stage(
        parts.join(counted, "token", "left")
        .withColumn("frequency", F.coalesce("frequency", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest))
        .where("rank = 1 AND frequency > 0")
        .select("token", "offset", F.size("window").alias("length"), "window"),
        "prefix-index",
    )
    probed = _probed(cut, lengths, index)
    start = F.col("at") - F.col("entry.offset")
    inside = (start >= 0) & (start + F.col("entry.length") <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("entry.length")) == F.col("entry.window")
    found = (
        probed.where((F.col("at") < 0) | (inside & same))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("at") >= 0, start).alias("start"), "entry.window")
    )
    hits = found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", F.size("window").alias("length")))).alias("hits"),
        F.collect_set("window").alias("windows"),
    )
    ids = (
        hits.select("doc_id", F.explode("windows").alias("window"))
        .join(windows, "window")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    release(parts)
    return hits.drop("windows").join(ids.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")


def _positions() -> Column:
    covered = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(covered))).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of any item."""
    # By row, as rows may share an id or have none.
    rows = stage(docs.select(packed(docs).alias("doc"), F.monotonically_increasing_id().alias("at")), "decontamination-rows")
    hit = find_hits(rows.select(F.col("at").alias("doc_id"), "doc.text"), items).where(F.size("hits") > 0).select(F.col("doc_id").alias("at"))
    return rows.join(hit, "at", "left_anti").select("doc.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id", stored_row().alias("at")).alias("doc_id"), "text")
    found = find_hits(docs, read(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id.doc_id",
        "n_words",
        _positions().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        hex_sha256(F.array_join(items, ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
