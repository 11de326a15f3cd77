"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule falls on the golden-ratio point frac((k + 1) / phi) and takes the
source whose stretch of the cumulative weights holds that point, so every prefix of the
schedule is near the target shares. Slots are ranked per source; the r-th slot of a source
takes the r-th block of ``BLOCK`` words of that source's shuffled documents, which repeat
when they run out, at most ``CAP`` times. Ranks and word offsets are running totals in two
levels, buckets and rows, so that no task holds a whole source.

Cases. A null text has no words. Documents without words take no part in blocks and are
taken 0 times. A null source is a source of its own, after all others. Rows with equal
doc_id are separate documents; fully equal rows are interchangeable. An empty table, or one
without words, gives an empty schedule. Other columns are not looked at.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import packed, read, release, stage, unpacked

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
BLOCK = 64
CELLS = 4096  # of the grid that finds a point's source
RUN = 65_536  # slots ranked together
WORD = r"[^\x20\x09-\x0D]+"

# frac(1 / phi) as a fraction good to 128 bits, and that of 2^20 steps.
_GOLDEN = Fraction(math.isqrt(5 * 4**140) - 2**140, 2**141)
STEP = float(_GOLDEN)
LEAP = float((_GOLDEN * 2**20) % 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point(k: Column) -> Column:
    """frac((k + 1) / phi); in two steps, so that no digits are lost for large k."""
    n = k + 1
    high, low = F.shiftright(n, 20), n.bitwiseAND(F.lit(2**20 - 1))
    x = (high * F.lit(LEAP)) % 1 + (low * F.lit(STEP)) % 1
    return x % 1


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: its words, weight and target; one row a source.

    A source is at its cap if the cap is at most what the level of the sources after it,
    in order of cap by weight, would give it; the others share what the capped ones leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sums.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))).withColumn(
        "most", F.col("source_size") * F.lit(float(cap))
    )
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / F.sum("weight").over(rest))
    free = F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))
    return levelled.withColumn("common", F.min_by(free, F.when(free.isNotNull(), F.col("most") / F.col("weight"))).over(every)).select(
        "source", "source_size", "weight",
        F.coalesce(F.least("most", F.col("common") * F.col("weight")), "most").alias("target"),
    )


def with_stretches(plan: DataFrame) -> DataFrame:
    """Number the sources (``sid``) and give each its stretch of the cumulative weights; the last ends at 1."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("target").over(Window.partitionBy())
    return plan.select("*", F.row_number().over(order).alias("sid"), upto.alias("upto"), total.alias("total")).select(
        "source", "source_size", "weight", "target", "sid",
        F.when(F.col("total") > 0, (F.col("upto") - F.col("target")) / F.col("total")).otherwise(0.0).alias("low"),
        F.when(F.col("total") > F.col("upto"), F.col("upto") / F.col("total")).otherwise(1.0).alias("high"),
    )


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot: slot, sid (number of its source), rank in that source."""
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    slots = int(total // block) + (total % block > 0)
    cells = plan.select(
        "sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell")
    )
    # ``cells`` has at most a row per grid cell and two per source.
    landed = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * CELLS))
        .join(F.broadcast(cells) if plan.count() <= CELLS else cells, "cell")
        .where("low <= u AND u < high")
        .select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    )
    offsets = running(landed.groupBy("sid", "run").agg(F.count("*").alias("n")), "sid", "run", "n")
    inside = Window.partitionBy("sid", "run").orderBy("slot")
    return (
        landed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["sid", "run"])
        .select("slot", "sid", (F.col("offset") + F.col("rank")).alias("rank"))
    )


def running(sums: DataFrame, group: str, bucket: str, value: str) -> DataFrame:
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, bucket, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("offset"))


def mix(docs: DataFrame, row: Column, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sources' plan, and the documents (row, doc_id, size, sid, taken) with the words the mix takes of each.

    ``row`` is a number that tells rows apart which share an id or have none; it orders them and shuffles the latter.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("row"))
    sized = stage(sized, "mix-sizes")
    plan = stage(with_stretches(targets(sized)), "mix-plan")
    slots = schedule(spark, plan.where("target > 0"))

    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))).cast("binary"))
    known = sized.join(
        F.broadcast(plan.select("source", "sid", "source_size")) if plan.count() <= CELLS else plan.select("source", "sid", "source_size"),
        sized["source"].eqNullSafe(plan["source"]),
    ).select("row", "doc_id", sized["source"], "size", "sid", "source_size", shuffled.alias("h")).withColumn(
        "bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    )
    buckets = running(known.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "sid", "bucket", "n")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row")
    placed = stage(
        known.withColumns({
            "place": F.row_number().over(inside),
            "end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }).join(buckets, ["sid", "bucket"]).withColumn("first", F.col("offset") + F.col("end") - F.col("size")).drop("end", "offset", "h"),
        "mix-order",
    )
    rounds = F.explode(F.sequence(F.lit(0), F.lit(CAP - 1)))
    begin, finish = F.col("first") + F.col("epoch") * F.col("source_size"), F.col("begin") + F.col("size")
    pieces = (
        placed.where("size > 0")
        .select("sid", "bucket", "place", "first", "size", "source_size", rounds.alias("epoch"))
        .withColumn("begin", begin)
        .withColumn("finish", finish)
        .select("sid", "bucket", "place", "begin", "finish", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("finish") - 1) / BLOCK))).alias("rank"))
    )
    overlap = F.least("finish", (F.col("rank") + 1) * BLOCK) - F.greatest("begin", F.col("rank") * BLOCK)
    # Merged, as slots and documents grow with the input: what is small as a compressed shuffle takes ten times that of the driver when broadcast.
    taken = (
        pieces.withColumn("words", overlap).join(slots.hint("merge"), ["sid", "rank"])
        .groupBy("sid", "bucket", "place").agg(F.sum("words").alias("taken"))
    )
    result = placed.join(taken.hint("merge"), ["sid", "bucket", "place"], "left").select(
        "row", "doc_id", "source", "size", "source_size", "sid", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    release(sized)
    return plan, result


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, each row to the nearest whole number.

    Documents without words fill no block and stay once.
    """
    rows = stage(docs.select(packed(docs).alias("doc"), F.monotonically_increasing_id().alias("at")), "mix-rows")
    _, mixed = mix(rows.select("at", "doc.doc_id", "doc.source", "doc.text"), F.col("at"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    taken = mixed.select(F.col("row").alias("at"), copies.alias("copies")).where("copies > 0")
    repeated = rows.join(taken, "at").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return unpacked(repeated, "doc", docs.columns)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, mixed = mix(read(spark, sf_dir, "documents"), F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    wanted = plan.select("sid", "target")
    return mixed.join(F.broadcast(wanted) if plan.count() <= CELLS else wanted, "sid").select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )
