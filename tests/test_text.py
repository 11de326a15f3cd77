"""Display forms against Python's own formatting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketlens.functions import text


def test_numbers(spark):
    rng = random.Random(3)
    values = [0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 2.675, -0.04, -13.35, 999.5, 1234.5, 1e7 + 0.5]
    values += [rng.uniform(-1e6, 1e6) for _ in range(300)] + [rng.randrange(-8000, 8000) / 16 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    shown = df.select(
        text.grouped_number("x"), text.grouped_number("x", 2), text.plain_number("x", 1), text.plain_number("x", 2),
        text.reais("x"),
    )
    for value, row in zip(values, shown.collect()):
        assert tuple(row) == (
            f"{value:,.0f}", f"{value:,.2f}", f"{value:.1f}", f"{value:.2f}", f"R$ {value:,.0f}",
        )


def test_missing_numbers(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = df.select(text.plain_number("x", 1), text.or_not_available(text.grouped_number("x"))).first()
    assert tuple(row) == (None, "N/A")


def test_titles(spark):
    names = [
        "sao paulo", "SANTA BARBARA D'OESTE", "mogi-guacu", "são joão del-rei", "rua 3a, norte", "", " x", "água ÉBANO",
    ]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    assert [r[0] for r in df.select(text.title_case("n")).collect()] == [n.title() for n in names]
    assert spark.sql("SELECT CAST(NULL AS string) AS n").select(text.title_case("n")).first()[0] is None


def test_short_ids(spark):
    df = spark.createDataFrame([("0123456789abcdef",), ("abc",)], "i string").coalesce(1)
    assert [r[0] for r in df.select(text.short_id("i", 8)).collect()] == ["01234567…", "abc…"]
    assert spark.range(12345, 12346).select(text.short_id("id", 3)).first()[0] == "123…"


def test_zip_codes(spark):
    codes = [str(n) for n in (0, 7, 99, 1046, 12345, 123456)]
    df = spark.createDataFrame([(c,) for c in codes], "c string").coalesce(1)
    assert [r[0] for r in df.select(text.pad_zip(F.col("c"))).collect()] == [c.zfill(5) for c in codes]


def test_null_words(spark):
    words = ["", "NA", "nan", "NULL", "none", "N/A", "Nan", "ok"]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    kept = [r[0] for r in df.select(text.null_tokens_to_null(F.col("w"))).collect()]
    assert kept == [None, None, None, None, "none", None, "Nan", "ok"]
    assert spark.sql("SELECT CAST(NULL AS string) AS w").select(text.null_tokens_to_null(F.col("w"))).first()[0] is None
