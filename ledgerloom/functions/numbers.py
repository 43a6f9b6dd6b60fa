"""Money, ratios and their rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def to_money(amount: Column) -> Column:
    """Cents, rounded half up; null when the amount does not fit."""
    return amount.try_cast("decimal(12,2)")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / whole.cast("double")
    )


def f1_score(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / both)


def per_million(amount: Column) -> Column:
    """Divide a decimal sum by a million and round to a millionth."""
    scaled = amount.cast("decimal(28,4)") * F.lit(Decimal("0.000001"))
    return F.round(scaled, 6).cast("decimal(28,6)")


def valid_amount(amount: Column) -> Column:
    """True for a finite number that is not negative."""
    return ~F.isnan(amount) & (amount >= 0) & (amount < F.lit(float("inf")))
