"""Row filters shared by the reports."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import before_next_day, day_text
from ..functions.text import contains_ignoring_case
from ..schemas import COMPLETED

Day = str | dt.date


def day(value: Day) -> Column:
    return F.lit(value).cast("date")


def reportable(receipts: DataFrame) -> DataFrame:
    """Completed receipts with a total: the only rows any report counts."""
    return receipts.filter((F.col("status") == COMPLETED) & F.col("total_amount").isNotNull())


def dated_between(receipts: DataFrame, first: Day, last: Day) -> DataFrame:
    """Receipt date in an inclusive range; undated receipts drop out."""
    return receipts.filter(F.col("receipt_date").between(day(first), day(last)))


def called_between(calls: DataFrame, first: Day, last: Day) -> DataFrame:
    """Calls made on the days of an inclusive range.

    Written as bounds on ``created_at`` itself so that they reach the file scan.
    """
    made = F.col("created_at")
    return calls.filter(
        (made >= day(first).cast("timestamp")) & (made < before_next_day(day(last)))
    )


def in_any_category(receipts: DataFrame, bridge: DataFrame, names: list[str] | None) -> DataFrame:
    """Receipts with at least one of the names, each once; no names is no filter."""
    if not names:
        return receipts
    wanted = bridge.filter(F.col("category").isin(*names)).select(F.col("receipt_id").alias("id"))
    return receipts.join(wanted, "id", "left_semi")


def merchant_contains(receipts: DataFrame, needle: str | None) -> DataFrame:
    if not needle:
        return receipts
    return receipts.filter(contains_ignoring_case(F.col("merchant"), F.lit(needle)))


def total_between(
    receipts: DataFrame, low: Decimal | float | None, high: Decimal | float | None
) -> DataFrame:
    """Inclusive bounds on the total; each one is optional."""
    total = F.col("total_amount")
    if low is not None:
        receipts = receipts.filter(total >= F.lit(Decimal(str(low))))
    if high is not None:
        receipts = receipts.filter(total <= F.lit(Decimal(str(high))))
    return receipts


def same_or_both_missing(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def by_ids(receipts: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup for a whole list of ids at once."""
    return receipts.join(ids.select("id").distinct(), "id", "left_semi")


def first_cases(cases: DataFrame, count: int) -> DataFrame:
    """The first ``count`` cases in file order: the evaluation's own limit option."""
    return cases.orderBy("position").limit(count)


def response_view(receipts: DataFrame) -> DataFrame:
    """A stored receipt as callers see it: days as text, amounts as numbers."""
    number = lambda name: F.col(name).cast("double").alias(name)
    return receipts.select(
        "id",
        "merchant",
        "merchant_details",
        F.col("merchant_vatnumber").alias("merchant_vatNumber"),
        "merchant_phone",
        "invoice_number",
        "location",
        day_text(F.col("receipt_date")).alias("date"),
        number("total_amount"),
        "currency",
        number("total_eur"),
        number("fx_rate"),
        day_text(F.col("fx_date")).alias("fx_date"),
        "categories",
        "payment_method",
        number("confidence_score"),
        "is_suspicious",
        "flag_reason",
        "duplicate_of",
        "status",
        "created_at",
    )
