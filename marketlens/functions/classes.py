"""Value tiers, buckets, threshold flags and quadrants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display order of the classes and labels of the codes.
VALUE_TIERS = ["<50", "50–200", "200–500", "500–1000", "1000+"]
INSTALLMENT_BUCKETS = ["1", "2–3", "4–6", "7–12", "12+"]
SCORE_BUCKETS = ["Negative (1–2)", "Neutral (3)", "Positive (4–5)"]
PAYMENT_LABELS = {
    "credit_card": "Credit Card",
    "boleto": "Boleto",
    "voucher": "Voucher",
    "debit_card": "Debit Card",
}
STAGE_LABELS = {
    "avg_days_to_approve": "Order → Approval",
    "avg_days_to_pickup": "Approval → Carrier",
    "avg_transit_days": "Carrier → Delivery",
}
LATE, ON_TIME = "Late", "Early / On Time"
REVIEW_GOOD, REVIEW_FAIR, LATE_PCT_LIMIT, FREIGHT_RATIO_LIMIT = 4.0, 3.0, 10.0, 0.30


def _steps(conditions: list[Column], labels: list[str]) -> Column:
    """First label whose condition holds, else the last label (also for NULL)."""
    expr = F.when(conditions[0], labels[0])
    for condition, label in zip(conditions[1:], labels[1:]):
        expr = expr.when(condition, label)
    return expr.otherwise(labels[-1])


def value_tier(c: str = "total_item_value") -> Column:
    return _steps([F.col(c) < top for top in (50, 200, 500, 1000)], VALUE_TIERS)


def installment_bucket(c: str | Column = "max_installments") -> Column:
    n = F.col(c) if isinstance(c, str) else c
    return _steps([n == 1, n <= 3, n <= 6, n <= 12], INSTALLMENT_BUCKETS)


def score_bucket(c: str = "min_review_score") -> Column:
    return _steps([F.col(c) <= 2, F.col(c) == 3], SCORE_BUCKETS)


def rank_in(c: str, ordered: list[str]) -> Column:
    """Position of a class in its display order, from 1."""
    return F.array_position(F.array(*map(F.lit, ordered)), F.col(c))


def delay_status(c: str = "delay_days") -> Column:
    return F.when(F.col(c) > 0, LATE).otherwise(ON_TIME)


def review_flag(c: str = "avg_review_score") -> Column:
    """green, yellow or red; NULL without a score."""
    score = F.col(c)
    return F.when(score >= REVIEW_GOOD, "green").when(score >= REVIEW_FAIR, "yellow").when(score.isNotNull(), "red")


def late_flag(c: str = "late_pct") -> Column:
    return F.when(F.col(c) > LATE_PCT_LIMIT, "red")


def freight_flag(c: str = "avg_freight_ratio") -> Column:
    return F.when(F.col(c) > FREIGHT_RATIO_LIMIT, "red")


def quadrant(review: str = "avg_review_score", late: str = "late_pct") -> Column:
    """Where a group lies against the two guide lines."""
    good, late_heavy = F.col(review) >= REVIEW_GOOD, F.col(late) > LATE_PCT_LIMIT
    return (
        F.when(~good & late_heavy, "problem")
        .when(good & ~late_heavy, "high quality")
        .when(good, "good but late")
        .otherwise("low review, on time")
    )


def bubble_size(c: str = "gmv") -> Column:
    """Log-scaled size, at least 1."""
    return F.greatest(F.log1p(F.col(c)), F.lit(1.0))
