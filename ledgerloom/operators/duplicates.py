"""Repeated submissions: same merchant, day, total and currency as an earlier receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import has_text, merchant_key
from ..schemas import COMPLETED
from .joining import salted_lookup

KEY = ["dup_merchant", "dup_day", "dup_total", "dup_currency", "dup_no_currency"]


def complete_key() -> Column:
    """Merchant, date and total must all be present; a missing currency is a value."""
    return (
        has_text(F.col("merchant"))
        & F.col("receipt_date").isNotNull()
        & F.col("total_amount").isNotNull()
    )


def keyed(receipts: DataFrame) -> DataFrame:
    """Add the key columns. Two missing currencies are equal, so they get a marker."""
    return receipts.withColumns(
        {
            "dup_merchant": merchant_key(F.col("merchant")),
            "dup_day": F.col("receipt_date"),
            "dup_total": F.col("total_amount").cast("decimal(12,2)"),
            "dup_currency": F.coalesce("currency", F.lit("")),
            "dup_no_currency": F.col("currency").isNull(),
        }
    )


def _completed(history: DataFrame) -> DataFrame:
    return keyed(history.filter((F.col("status") == COMPLETED) & complete_key()))


def _earliest(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The earliest of the keyed rows for each key, and their number; combined before the shuffle."""
    first = F.min(F.struct(*order)).alias("first")
    return rows.groupBy(*KEY).agg(first, F.count("*").alias("copies")).select(
        *KEY, F.col("first.id").alias("match_id"), F.col("first.created_at").alias("match_at"), "copies"
    )


def _matched(receipts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every receipt with ``match_id`` and ``match_at`` of its earlier copy, or nulls.

    The lookup has one row per key that can match; a group of copies that is a large part of
    the input is a skewed partition of this join, which adaptive execution splits.
    """
    matched = salted_lookup(keyed(receipts), lookup.drop("copies"), KEY, "id")
    usable = complete_key() & (F.col("match_id") != F.col("id"))
    return matched.withColumns(
        {
            "match_id": F.when(usable, F.col("match_id")),
            "match_at": F.when(usable, F.col("match_at")),
        }
    ).drop(*KEY)


def match_earliest(
    receipts: DataFrame, history: DataFrame, order: tuple[str, ...] = ("created_at", "id")
) -> DataFrame:
    """Every receipt with the earliest completed receipt of ``history`` that has its key.

    Only keys that the receipts have are looked for in the history.
    """
    wanted = keyed(receipts.filter(complete_key())).select(*KEY).distinct()
    return _matched(receipts, _earliest(_completed(history).join(wanted, KEY, "left_semi"), order))


def first_copies(receipts: DataFrame, new: Column, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The earliest completed receipt for each key (KEY, match_id, match_at) that several have, at least one of them ``new``."""
    found = _completed(receipts).groupBy(*KEY).agg(
        F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"), F.bool_or(new).alias("asked")
    )
    return found.filter((F.col("copies") > 1) & F.col("asked")).select(
        *KEY, F.col("first.id").alias("match_id"), F.col("first.created_at").alias("match_at")
    )


def match_firsts(receipts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Every receipt with its ``first_copies`` row, or nulls; a first one has none."""
    return _matched(receipts, firsts.withColumn("copies", F.lit(None)))


def linked(receipts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Completed receipts that repeat an earlier one, given the first copy of each key (KEY, match_id, match_at)."""
    completed = receipts.filter(F.col("status") == COMPLETED)
    return _matched(completed, firsts.withColumn("copies", F.lit(None))).filter(F.col("match_id").isNotNull())


def snapshot_duplicates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """New receipts that repeat one already completed; ``history`` holds none of them."""
    return match_earliest(batch, history).filter(F.col("match_id").isNotNull())


def replay_duplicates(receipts: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Completed receipts that repeat an earlier one of the same table.

    "Earlier" is (created_at, id) order; all copies point at the first of them. Only keys that
    several receipts have are looked up.
    """
    completed = receipts.filter(F.col("status") == COMPLETED)
    repeated = _earliest(_completed(completed), order).filter(F.col("copies") > 1)
    return _matched(completed, repeated).filter(F.col("match_id").isNotNull())
