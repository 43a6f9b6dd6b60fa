"""The flags a receipt carries, and how several of them become one verdict."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import day_text, weekend_name
from ..functions.text import any_reason, has_text, join_reasons
from .duplicates import match_earliest
from .spreads import outlier_reason, outliers


def weekend_reason(day: Column) -> Column:
    return F.concat(F.lit("Issued on a "), weekend_name(day), F.lit("."))


def duplicate_reason(match_id: Column, match_at: Column) -> Column:
    """Null when nothing matched: concat of a null is null."""
    return F.concat(
        F.lit("Same merchant, date and total as receipt "),
        match_id.cast("string"),
        F.lit(", submitted on "),
        day_text(match_at),
        F.lit("; possible duplicate submission."),
    )


def with_reasons(receipts: DataFrame, *reasons: Column) -> DataFrame:
    """Union the base verdict with whatever fired."""
    flag = F.coalesce("is_suspicious", F.lit(False))
    return receipts.withColumns(
        {
            "is_suspicious": flag | any_reason(*reasons),
            "flag_reason": join_reasons(F.col("flag_reason"), *reasons),
        }
    )


def weekend_flags(receipts: DataFrame) -> DataFrame:
    return with_reasons(receipts, weekend_reason(F.col("receipt_date")))


def missing_fields(receipts: DataFrame) -> DataFrame:
    """Receipts without a total, or without a date although the rest is there.

    The wording is this library's own: the rule comes from a written instruction,
    not from stored sentences.
    """
    no_total = F.col("total_amount").isNull()
    no_date = F.col("receipt_date").isNull() & ~no_total & has_text(F.col("merchant"))
    reason = F.when(no_total, "The total is missing.").when(no_date, "The date is missing.")
    return receipts.withColumn("missing_reason", reason).filter(F.col("missing_reason").isNotNull())


def unreconciled(
    receipts: DataFrame, items: DataFrame, tolerance: Decimal = Decimal("0.01")
) -> DataFrame:
    """Receipts whose total is off the sum of their item amounts by more than a share.

    ``items`` has (receipt_id, amount). Receipts without items or total are not judged.
    """
    sums = items.groupBy(F.col("receipt_id").alias("id")).agg(F.sum("amount").alias("items_total"))
    joined = receipts.filter(F.col("total_amount").isNotNull()).join(sums, "id")
    gap = F.abs(F.col("total_amount") - F.col("items_total"))
    return joined.withColumn("gap", gap).filter(
        gap > F.lit(tolerance) * F.abs(F.col("total_amount"))
    )


def verdicts(
    receipts: DataFrame, history: DataFrame, bridge: DataFrame, leave_self_out: bool = False
) -> DataFrame:
    """Weekend, duplicate and outlier checks united with the base verdict.

    Adds ``duplicate_of``; ``is_suspicious`` and ``flag_reason`` carry the union.
    """
    far_above = outliers(receipts, history, bridge, leave_self_out=leave_self_out)
    return united(weekend_flags(match_earliest(receipts, history)), far_above)


def united(matched: DataFrame, far_above: DataFrame) -> DataFrame:
    """The history checks on top of a verdict that already holds the weekend check."""
    verdict = with_reasons(
        matched.join(far_above, "id", "left"),
        duplicate_reason(F.col("match_id"), F.col("match_at")),
        outlier_reason(F.col("total_amount"), F.col("currency")),
    )
    return verdict.withColumn("duplicate_of", F.col("match_id")).drop(
        "match_id", "match_at", "category", "sample_size", "p90"
    )
