"""Commonest values by counting.

The builtin mode keeps every different value of a key in one buffer. Here (key, value) pairs are counted first, with partial counts ahead of
the shuffle, so that a hot key is spread over its values; then the least (-count, value) of each key is its commonest value. Buffers
have a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def commonest(
    df: DataFrame,
    key: str,
    columns: list[str],
    totals: Mapping[str, Column] | None = None,
    merges: Mapping[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """``key``, the commonest value of each of ``columns``, and ``totals`` of all its rows.

    Tied values give the smallest; missing values don't count, and a key without any has none. ``totals`` are aggregates
    whose parts ``merges`` puts together, by default as sums. Columns are text.
    """
    totals, merges = dict(totals or {}), dict(merges or {})
    merged = [merges.get(name, F.sum)(name).alias(name) for name in totals]
    n = F.count(F.lit(1)).alias("_n")
    counted = df.groupBy(key, *columns).agg(n, *[total.alias(name) for name, total in totals.items()])
    if len(columns) == 1:
        pairs = counted.withColumnsRenamed({columns[0]: "_value"}).withColumn("_column", F.lit(0))
    else:
        # Each column in turn; the totals go with the first, so that they count once.
        rows = [
            F.struct(
                F.lit(i).alias("_column"),
                F.col(c).alias("_value"),
                F.col("_n").alias("_n"),
                *[(F.col(t) if i == 0 else F.lit(None)).alias(t) for t in totals],
            )
            for i, c in enumerate(columns)
        ]
        pairs = counted.select(key, F.inline(F.array(*rows)))
        pairs = pairs.groupBy(key, "_column", "_value").agg(F.sum("_n").alias("_n"), *merged)

    def first(i: int) -> Column:
        known = (F.col("_column") == i) & F.col("_value").isNotNull()
        return F.min(F.when(known, F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("value"))))

    best = pairs.groupBy(key).agg(*[first(i).alias(f"_best{i}") for i in range(len(columns))], *merged)
    return best.select(key, *[F.col(f"_best{i}.value").alias(c) for i, c in enumerate(columns)], *totals)
