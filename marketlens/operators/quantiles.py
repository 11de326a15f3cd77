"""Exact quantiles per group by bracketed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.measures import ITEMS

#: A sketch's percentile is at most one in so many of a group's values away from the rank asked for.
ACCURACY = 10_000
#: Brackets reach so many times that error to either side of the wanted rank.
REACH = 4


def _values(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A row for each row and measure: ``by``, measure, value, and the items ``n`` it stands for."""
    for key in by:
        df = df.where(F.col(key).isNotNull())
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    weight = F.col(ITEMS).cast("long") if ITEMS in df.columns else F.lit(1).cast("long")
    return df.select(*by, weight.alias("n"), F.inline(F.array(*pairs)))


def _repeated(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each item; that stays inside the task."""
    return values.select(*keys, "value", F.explode(F.expr("sequence(1L, n)")).alias("copy")).select(*keys, "value")


def _brackets(values: DataFrame, keys: Sequence[str], probs: Sequence[float], weighted: bool) -> DataFrame:
    """One row per group and measure: its items, count, sum and extremes of values, and a bracket for each quantile.

    A bracket has the ranks, from 0, between which the quantile lies, and two values that surely enclose them.
    """
    reach = REACH / ACCURACY
    marks = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-reach, reach)]
    # The sketch knows no weights.
    each = _repeated(values, keys) if weighted else values
    figures = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("value").alias("total"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.percentile_approx("value", marks, ACCURACY).alias("marks"),
    )

    def bracket(i: int, prob: float) -> Column:
        at = F.lit(float(prob)) * (F.col("total") - 1)
        # Of few values the error is less than one rank; there all of them are kept.
        few = F.col("total") < 2 * ACCURACY
        low, high = (F.get("marks", F.lit(2 * i + side)) for side in (0, 1))
        return F.struct(
            F.lit(float(prob)).alias("prob"),
            F.floor(at).alias("first"),
            F.ceil(at).alias("last"),
            (at - F.floor(at)).alias("part"),
            (F.col("min") if marks[2 * i] == 0 else F.when(few, F.col("min")).otherwise(low)).alias("low"),
            (F.col("max") if marks[2 * i + 1] == 1 else F.when(few, F.col("max")).otherwise(high)).alias("high"),
        )

    found = F.array(*[bracket(i, p) for i, p in enumerate(probs)])
    return figures.select(*keys, "items", "total", "sum", "min", "max", found.alias("brackets"))


def _quantiles(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts what lies below each bracket and keeps only values inside; of these the ranks are found."""
    wanted = F.broadcast(brackets.where("total > 0").select(*keys, "brackets"))
    near = F.filter("brackets", lambda b: F.col("value") <= b["high"])
    met = values.where("value IS NOT NULL").join(wanted, list(keys)).select(*keys, "value", "n", F.explode(near).alias("b"))
    below = F.col("value") < F.col("b.low")
    # What lies below a bracket folds into one row a task; only values inside travel.
    counted = met.groupBy(*keys, F.col("b.prob").alias("prob"), F.when(~below, F.col("value")).alias("value")).agg(F.sum("n").alias("n"))

    ranked = Window.partitionBy(*keys, "prob").orderBy(F.col("value").asc_nulls_first())
    ended = counted.withColumn("end", F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = ended.join(wanted, list(keys)).select(
        *keys, "prob", "value", "n", "end", F.get(F.filter("brackets", lambda b: b["prob"] == F.col("prob")), F.lit(0)).alias("b")
    )
    holds = [(F.col(f"b.{rank}") >= F.col("end") - F.col("n")) & (F.col(f"b.{rank}") < F.col("end")) for rank in ("first", "last")]
    inside = F.col("value").isNotNull()
    at_rank = F.when(inside & (holds[0] | holds[1]), F.col("value"))
    picked = again.groupBy(*keys, "prob").agg(
        F.min(at_rank).alias("low"), F.max(at_rank).alias("high"), F.max("b.part").alias("part"),
        F.max(inside & holds[0]).alias("has_first"), F.max(inside & holds[1]).alias("has_last"),
    )
    # Never a wrong quantile: if a sketch were worse than promised, the query fails.
    sure = F.assert_true(F.col("has_first") & F.col("has_last"), "a quantile lies outside its bracket").isNull()
    return picked.where(sure).select(*keys, "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))


def _both(df: DataFrame, by: Sequence[str], measures: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    keys = [*by, "measure"]
    values = _values(df, by, measures)
    brackets = _brackets(values, keys, probs, ITEMS in df.columns)
    return brackets, _quantiles(values, brackets, keys)


def exact_quantiles(df: DataFrame, by: Sequence[str], measures: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles: ``by``, ``measure``, ``prob``, ``quantile``.

    The builtin exact percentile keeps every distinct value of a group in one buffer. Here a first
    pass sketches each group, which gives two values that surely enclose a wanted rank, however the values are spread.
    A second pass counts the values below exactly and shuffles those between, about one in a
    thousand, for the rank to be found. ``by`` names classes of a report: a row for each of them and measure
    is broadcast. NULL values and rows whose group is NULL do not count.
    """
    return _both(df, by, measures, probs)[1]


def medians(df: DataFrame, by: Sequence[str], measures: Sequence[str], prefix: str = "median_") -> DataFrame:
    """One row per group: its rows ``n`` and the median of each measure, NULL where no row has a value."""
    brackets, found = _both(df, by, measures, [0.5])
    # Every row counts once under each measure, so any measure gives the rows.
    groups = brackets.where(F.col("measure") == measures[0]).select(*by, F.col("items").alias("n"))
    wide = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("quantile"))).alias(f"{prefix}{m}") for m in measures]
    )
    return groups.join(wide, list(by), "left")


def box_statistics(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Count, mean and five-number summary of each measure in each group."""
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    brackets, found = _both(df, by, measures, list(quartiles.values()))
    wide = found.groupBy(*by, "measure").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in quartiles.items()]
    )
    summary = brackets.select(
        *by, "measure", F.col("total").alias("n"), F.try_divide("sum", "total").alias("mean"), "min", "max"
    )
    return summary.join(wide, [*by, "measure"])
