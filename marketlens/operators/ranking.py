"""Ordered results and top-k with complete tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def largest(df: DataFrame, n: int, metric: str, keys: list[str]) -> DataFrame:
    """``n`` rows with the largest metric; equal ones by key."""
    return df.orderBy(*descending(metric), *ascending(*keys)).limit(n)


def smallest(df: DataFrame, n: int, metric: str, then: list[str], keys: list[str]) -> DataFrame:
    """``n`` rows with the smallest metric; equal ones by the largest ``then``, then by key."""
    return df.orderBy(*ascending(metric), *descending(*then), *ascending(*keys)).limit(n)


def top_per_group(df: DataFrame, n: int, group: list[str], metric: str, keys: list[str], rank: str = "rank") -> DataFrame:
    """``n`` rows with the largest metric in each group, numbered from 1."""
    order = Window.partitionBy(*group).orderBy(*descending(metric), *ascending(*keys))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
