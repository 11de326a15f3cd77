"""Raw CSV tables: schemas, cleaning, Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.text import null_tokens_to_null, pad_zip

ZIP = "zip"  # a text code padded to five digits

# The nine raw tables, the columns later steps use, and their types.
RAW_SCHEMAS: dict[str, dict[str, str]] = {
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": ZIP,
        "customer_city": "string",
        "customer_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": ZIP,
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "double",
        "freight_value": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "double",
    },
    "order_reviews": {
        "order_id": "string",
        "review_score": "tinyint",
        "review_creation_date": "timestamp_ntz",
        "review_answer_timestamp": "timestamp_ntz",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_weight_g": "double",
    },
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": ZIP,
        "seller_city": "string",
        "seller_state": "string",
    },
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# Free text with line breaks. Such a file cannot be split between tasks, so
# only this table pays for it; supply it as many files.
MULTILINE_TABLES = {"order_reviews"}


def clean(df: DataFrame, table: str) -> DataFrame:
    """Type the text columns of a raw table; other columns stay text.

    A timestamp that cannot be read becomes NULL; a bad number is an error.
    """
    schema = RAW_SCHEMAS[table]
    missing = sorted(set(schema) - set(df.columns))
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    cleaned = []
    for name in df.columns:
        value = null_tokens_to_null(F.col(name))
        kind = schema.get(name, "string")
        if kind == ZIP:
            value = pad_zip(value)
        elif kind == "timestamp_ntz":
            value = value.try_cast("timestamp_ntz")
        elif kind in ("int", "tinyint"):
            # Whole numbers may be written as 3.0.
            value = value.cast("double").cast(kind)
        else:
            value = value.cast(kind)
        cleaned.append(value.alias(name))
    return df.select(*cleaned)


def read_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One raw table. Columns are found by header name, never by inference of types."""
    text = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", table in MULTILINE_TABLES)
        .csv(path)
    )
    return clean(text, table)


def read_raw(spark: SparkSession, paths: Mapping[str, str] | str) -> dict[str, DataFrame]:
    """All raw tables, from a path per table or from ``<folder>/<table>.csv``."""
    if isinstance(paths, str):
        paths = {table: f"{paths.rstrip('/')}/{table}.csv" for table in RAW_SCHEMAS}
    return {table: read_csv(spark, table, paths[table]) for table in RAW_SCHEMAS}
