"""A hand-made shop as raw CSV files, a few rows per table, one oddity per row."""

from __future__ import annotations

import csv
import json
from pathlib import Path

TABLES: dict[str, list[list]] = {
    "customers": [
        ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
        ["c1", "u1", "1046", "sao paulo", "SP"],
        ["c2", "u1", "20000", "rio de janeiro", "RJ"],  # the same person
        ["c3", "u2", "99999", "nowhere", "SP"],  # no such zip code
        ["c4", "u3", "1046", "sao paulo", "SP"],
    ],
    "geolocation": [
        ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"],
        ["1046", "-23.5", "-46.5", "sp", "SP"],
        ["1046", "-23.75", "-46.75", "sao paulo", "SP"],  # tied city
        ["20000", "-22.5", "-43.25", "rio de janeiro", "RJ"],
        ["20000", "-22.5", "-43.25", "rio", "RJ"],
        ["20000", "-22.5", "-43.25", "rio", "ES"],
    ],
    "orders": [
        [
            "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
            "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        ],
        # late by 1.5 days
        ["o1", "c1", "delivered", "2017-01-01 10:00:00", "2017-01-01 12:00:00", "2017-01-02 12:00:00",
         "2017-01-11 12:00:00", "2017-01-10 00:00:00"],
        # on the estimate: not late; picked up before it was approved
        ["o2", "c2", "delivered", "2017-03-05 00:00:00", "2017-03-06 00:00:00", "2017-03-05 12:00:00",
         "2017-03-20 00:00:00", "2017-03-20 00:00:00"],
        # not delivered; approval cannot be read
        ["o3", "c3", "shipped", "2018-09-03 00:00:00", "not a date", "2018-09-04 00:00:00", "",
         "2018-09-30 00:00:00"],
        # bought on the last day, after midnight
        ["o4", "c4", "processing", "2018-09-03 10:00:00", "", "", "", "2018-10-01 00:00:00"],
        # no items
        ["o5", "c4", "canceled", "2018-01-01 00:00:00", "", "", "", "2018-02-01 00:00:00"],
    ],
    "order_items": [
        ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"],
        # one order, two sellers, two value tiers
        ["o1", "1", "p1", "s1", "2017-01-05 00:00:00", "40.0", "10.0"],
        ["o1", "2", "p2", "s2", "2017-01-05 00:00:00", "1000.0", "20.0"],
        ["o2", "1", "p3", "s1", "2017-03-08 00:00:00", "0.0", "5.5"],  # free
        ["o3", "1", "p4", "s2", "2018-09-08 00:00:00", "100.0", "50.0"],
        ["o4", "1", "p1", "s1", "2018-09-08 00:00:00", "199.0", "0.5"],
    ],
    "order_payments": [
        ["order_id", "payment_type", "payment_installments", "payment_value"],
        ["o1", "voucher", "1", "70.0"],
        ["o1", "credit_card", "13", "1000.0"],  # tied types
        ["o2", "coupon", "0", "5.5"],  # a type without a label
        ["o3", "boleto", "1", "100.0"],
        ["o3", "boleto", "1", "50.0"],
    ],
    "order_reviews": [
        ["order_id", "review_score", "review_comment", "review_creation_date", "review_answer_timestamp"],
        ["o1", "1", 'late,\nand "broken"', "2017-01-12 00:00:00", "2017-01-13 00:00:00"],
        ["o1", "4", "", "2017-01-14 00:00:00", "2017-01-15 00:00:00"],
        ["o2", "5.0", "fine", "2017-03-21 00:00:00", "2017-03-22 00:00:00"],
        ["o4", "3", "null", "2018-09-20 00:00:00", "2018-09-21 00:00:00"],
    ],
    "products": [
        ["product_id", "product_category_name", "product_weight_g", "product_photos_qty"],
        ["p1", "livros", "300", "1"],
        ["p2", "moveis", "12000", "2"],
        ["p3", "", "", "1"],  # no category
        ["p4", "raro", "50", "3"],  # no translation
    ],
    "sellers": [
        ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
        ["s1", "20000", "santa barbara d'oeste", "RJ"],
        ["s2", "55555", "recife", "PE"],  # no such zip code
    ],
    "category_translation": [
        ["product_category_name", "product_category_name_english"],
        ["livros", "books"],
        ["moveis", "furniture"],
    ],
}

BOUNDARIES = {
    "type": "FeatureCollection",
    "features": [
        {
            "type": "Feature",
            "properties": {"uf": uf, "state_name": name},
            "geometry": {"type": "Polygon", "coordinates": [[[x, 0.5], [x, 1.5], [x + 1, 1.5], [x, 0.5]]]},
        }
        for x, (uf, name) in enumerate([("SP", "São Paulo"), ("RJ", "Rio de Janeiro")])
    ],
}


def write_shop(folder: Path) -> None:
    for table, rows in TABLES.items():
        with open(folder / f"{table}.csv", "w", newline="", encoding="utf-8") as out:
            csv.writer(out).writerows(rows)
    (folder / "states.geojson").write_text(json.dumps(BOUNDARIES, ensure_ascii=False), encoding="utf-8")
