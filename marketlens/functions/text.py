"""Cleaning and display forms of text and numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts a CSV field may hold for "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def pad_zip(c: Column, width: int = 5) -> Column:
    """Left-pad with zeros; a longer code stays whole (``lpad`` alone would cut it)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def short_id(c: str | Column, length: int) -> Column:
    """First characters of an id and an ellipsis."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.substring(text, 1, length), F.lit("…"))


def title_case(c: str | Column) -> Column:
    """A capital at the start and after every character that is no letter, else small letters."""
    parts = F.split(c, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def label_of(c: str, labels: Mapping[str, str]) -> Column:
    """Display label of a coded value; NULL for a value without one."""
    expr = None
    for value, label in labels.items():
        hit = F.col(c) == value
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr


def grouped_number(c: str | Column, decimals: int = 0) -> Column:
    """``1,234.5`` with a thousands separator."""
    return F.format_number(c, decimals)


def plain_number(c: str | Column, decimals: int) -> Column:
    """``1234.5`` with fixed decimals and no separator."""
    return F.replace(F.format_number(c, decimals), F.lit(","), F.lit(""))


def reais(c: str | Column, decimals: int = 0) -> Column:
    return F.concat(F.lit("R$ "), grouped_number(c, decimals))


def or_not_available(c: Column) -> Column:
    return F.coalesce(c, F.lit("N/A"))
