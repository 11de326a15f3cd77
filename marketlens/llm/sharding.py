"""Sharding by histogram sort.

Rows are ordered by a key, a hash of the text and then one of the doc_id, so copies of a
text lie side by side and a large group of copies can still be cut, also where they repeat an
id or have none: the second hash takes in a number of the row. In every round one
job counts the exact bytes between evenly spaced probes inside the interval that holds
each undecided splitter; only these counts, at most shards x probes of them, come to the
driver. A splitter is settled when the bytes below a probe are within the tolerance of
its target. Then the rows are exchanged once.

Cases. A null text has no bytes and the hash of an empty text. Rows that repeat text and
doc_id, or have no doc_id, are keys of their own and may lie in different shards. A shard
may stay empty when there are fewer rows than shards; an empty table gives no rows.
Other columns are carried along; ``shard`` and ``slot`` replace input columns of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import packed, read, stage, stored_row, text_or_empty, unpacked

SHARDS = 40
PROBES = 1024
TOLERANCE = 0.0005  # of a shard's share
ROW_BYTES = 16
PIECES = 256  # of a shard, for numbering
TOP = 2**63 - 1


def key_columns(text: Column, doc_id: Column, row: Column) -> tuple[Column, Column]:
    """Two numbers of 63 bits; ``row`` tells rows of one text and id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 1), F.shiftrightunsigned(F.xxhash64(doc_id, row), 1)


@dataclass(frozen=True)
class Interval:
    """Keys with ``low <= k1 < high``, or, when ``text`` is set, with that k1 and ``low <= k2 < high``."""

    text: int | None
    low: int
    high: int

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // PROBES)

    @property
    def column(self) -> str:
        return "k1" if self.text is None else "k2"

    def holds(self) -> str:
        same = "" if self.text is None else f"k1 = {self.text}L AND "
        return f"{same}{self.column} >= {self.low}L AND {self.column} < {self.high}L"

    def probe(self) -> str:
        # Integer division: doubles can't tell keys of 63 bits apart.
        return f"int(({self.column} - {self.low}L) div {self.step}L)"


def _counts(keys: DataFrame, intervals: list[Interval]) -> dict[int, list]:
    """Bytes between probes and extremes of the keys there, for each interval."""
    cases = [f"WHEN {x.holds()} THEN struct({i} AS i, {x.probe()} AS probe)" for i, x in enumerate(intervals)]
    rows = (
        keys.withColumn("at", F.expr(f"CASE {' '.join(cases)} END"))
        .where("at IS NOT NULL")
        .withColumns({"i": F.col("at.i"), "probe": F.col("at.probe")})
        .groupBy("i", "probe")
        .agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("k1", "k2")])
        .collect()
    )
    found: dict[int, list] = {i: [] for i in range(len(intervals))}
    for row in rows:
        found[row["i"]].append(row)
    return {i: sorted(rows, key=lambda r: r["probe"]) for i, rows in found.items()}


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Lowest key (k1, k2) of the shards from the second on, for rows of k1, k2 and size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    open_ = {j: (Interval(None, 0, TOP), 0) for j in range(1, shards)}  # interval, bytes below it
    settled: dict[int, tuple[int, int]] = {}
    while open_:
        intervals = list(dict.fromkeys(interval for interval, _ in open_.values()))
        counts = _counts(keys, intervals)
        after = {}
        for j, (interval, below) in open_.items():
            target, rows = total * j / shards, counts[intervals.index(interval)]
            for row in rows:
                if below + row["bytes"] >= target:
                    break
                below += row["bytes"]
            else:  # nothing to cut
                settled[j] = (interval.text, interval.high) if interval.text is not None else (interval.high, 0)
                continue
            above = below + row["bytes"]
            first = (row["min_k1"], row["min_k2"] if interval.text is not None else 0)
            next_ = (row["max_k1"], row["max_k2"] + 1) if interval.text is not None else (row["max_k1"] + 1, 0)
            one_text = row["min_k1"] == row["max_k1"]
            if min(target - below, above - target) <= slack or one_text and row["min_k2"] == row["max_k2"]:
                settled[j] = first if target - below <= above - target else next_
            elif one_text:
                after[j] = (Interval(row["min_k1"], row["min_k2"], row["max_k2"] + 1), below)
            else:
                after[j] = (Interval(None, row["min_k1"], row["max_k1"] + 1), below)
        open_ = after
    return [settled[j] for j in range(1, shards)]


def shard_of(k1: Column, k2: Column, splitters: list[tuple[int, int]]) -> Column:
    at_or_above = [((k1 > a) | ((k1 == a) & (k2 >= b))).cast("int") for a, b in splitters]
    return sum(at_or_above, F.lit(0)).cast("int")


def number(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``slot``, gapless from 0 in every ``shard``.

    A shard is numbered by pieces, so no task holds a whole shard; ``pieces`` has
    shards x PIECES rows whatever the input.
    """
    pieces = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy(*order)
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "piece"]).withColumn(
        "slot", F.col("offset") + F.col("rank") - 1
    ).drop("piece", "rank", "offset")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (from 0 in each shard)."""
    k1, k2 = key_columns(text_or_empty(), F.col("doc_id"), F.monotonically_increasing_id())
    size = F.octet_length(text_or_empty()).cast("long") + ROW_BYTES
    # Written with the rows, as their numbers must not change between the count and the exchange.
    keyed = stage(docs.select(packed(docs).alias("row"), k1.alias("k1"), k2.alias("k2"), size.alias("size")), "shard-rows")
    splitters = find_splitters(keyed.drop("row"), shards)
    rows = keyed.drop("size").withColumns({"shard": shard_of(F.col("k1"), F.col("k2"), splitters), "piece": F.col("k2") % PIECES})
    return unpacked(number(rows, F.col("k1"), F.col("k2")), "row", docs.columns, "shard", "slot")


def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k1, k2 = key_columns(text_or_empty(), F.col("doc_id"), stored_row())
    docs = read(spark, sf_dir, "documents")
    keys = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            k1.alias("k1"),
            k2.alias("k2"),
        ),
        "shard-keys",
    )
    shard = shard_of(F.col("k1"), F.col("k2"), find_splitters(keys, SHARDS))
    rows = keys.withColumns({"shard": shard, "piece": F.col("k2") % PIECES})
    return number(rows, F.col("k1"), F.col("k2")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
