"""Spending totals. Currencies are never added together except as converted EUR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_key
from .categories import by_category
from .filters import (
    Day,
    dated_between,
    in_any_category,
    merchant_contains,
    reportable,
    total_between,
)


def period(receipts: DataFrame, first: Day, last: Day) -> DataFrame:
    return dated_between(reportable(receipts), first, last)


def eur_columns() -> list[Column]:
    """Converted sum (0 when nothing was converted) and the rows left out of it."""
    converted = F.count("total_eur")
    return [
        F.coalesce(F.sum("total_eur"), F.lit(0)).alias("total_eur"),
        (F.count("*") - converted).alias("unconverted"),
    ]


def category_totals(receipts: DataFrame, bridge: DataFrame, first: Day, last: Day) -> DataFrame:
    """Per category and currency; a receipt counts in full in each of its categories."""
    slim = period(receipts, first, last).select("id", "currency", "total_amount")
    totals = by_category(slim, bridge).groupBy("category", "currency").agg(
        F.count("*").alias("receipts"), F.sum("total_amount").alias("total")
    )
    return totals.orderBy(F.desc("total"), "category", F.asc_nulls_last("currency"))


def month_totals(receipts: DataFrame, first: Day, last: Day) -> DataFrame:
    """Per month and currency, every receipt once."""
    totals = (
        period(receipts, first, last)
        .groupBy(month_key(F.col("receipt_date")).alias("month"), "currency")
        .agg(F.count("*").alias("receipts"), F.sum("total_amount").alias("total"))
    )
    return totals.orderBy("month", F.asc_nulls_last("currency"))


def month_totals_eur(receipts: DataFrame, first: Day, last: Day) -> DataFrame:
    """Per month in EUR; a month stays even when nothing in it was converted."""
    totals = (
        period(receipts, first, last)
        .groupBy(month_key(F.col("receipt_date")).alias("month"))
        .agg(F.count("total_eur").alias("receipts"), *eur_columns())
    )
    return totals.orderBy("month")


def currency_totals(
    receipts: DataFrame,
    bridge: DataFrame,
    first: Day,
    last: Day,
    categories: list[str] | None = None,
    merchant: str | None = None,
    min_total=None,
    max_total=None,
) -> DataFrame:
    """Filtered totals per currency; a receipt in two wanted categories counts once."""
    rows = period(receipts, first, last)
    rows = total_between(merchant_contains(rows, merchant), min_total, max_total)
    rows = in_any_category(rows, bridge, categories)
    totals = rows.groupBy("currency").agg(
        F.count("*").alias("receipts"),
        F.sum("total_amount").alias("total"),
        *eur_columns(),
    )
    return totals.orderBy(F.asc_nulls_last("currency"))
