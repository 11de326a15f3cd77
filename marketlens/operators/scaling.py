"""Rescaling a measure over a whole result.

The extremes come from a one-row subquery, not from a window, which would move
all rows to one task. Rows and extremes share the shuffle of an aggregated frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_extremes(df: DataFrame, **measures: Column) -> DataFrame:
    """Add ``<name>_min`` and ``<name>_max`` of each named measure over all rows."""
    fields = []
    for name, measure in measures.items():
        fields += [F.min(measure).alias(f"{name}_min"), F.max(measure).alias(f"{name}_max")]
    bounds = df.agg(F.struct(*fields).alias("bounds")).scalar()
    return df.withColumn("_bounds", bounds).select(
        "*", *[F.col(f"_bounds.{name}_{end}").alias(f"{name}_{end}") for name in measures for end in ("min", "max")]
    ).drop("_bounds")


def position(measure: Column, name: str, floor: float = 1e-9) -> Column:
    """0 at the smallest value, 1 at the largest."""
    span = F.greatest(F.col(f"{name}_max") - F.col(f"{name}_min"), F.lit(floor))
    return (measure - F.col(f"{name}_min")) / span


def diverging(measure: Column, name: str) -> Column:
    """-1 to 1 around zero, by the extreme of either side but at least 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), measure / diverging_extent(name)))


def diverging_extent(name: str) -> Column:
    return F.greatest(F.abs(F.col(f"{name}_min")), F.col(f"{name}_max"), F.lit(1.0))


def spatial_extent(df: DataFrame, lat: str = "lat", lng: str = "lng", least: float = 0.5) -> DataFrame:
    """Centre and span of a set of points; points without coordinates do not count."""
    spans = df.dropna(subset=[lat, lng]).agg(
        F.avg(lat).alias("center_lat"),
        F.avg(lng).alias("center_lng"),
        (F.max(lat) - F.min(lat)).alias("lat_span"),
        (F.max(lng) - F.min(lng)).alias("lng_span"),
    )
    return spans.withColumn("span", F.greatest("lat_span", "lng_span", F.lit(least)))
