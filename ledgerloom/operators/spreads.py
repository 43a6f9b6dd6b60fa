"""What earlier receipts of a category cost, and receipts far above it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import money_text
from ..schemas import OUTLIER_MIN_RECEIPTS, OUTLIER_MULTIPLE, OUTLIER_QUANTILE, TAXONOMY
from .categories import by_category
from .filters import reportable
from .joining import fits, salted_lookup
from .percentiles import (
    between,
    cents,
    fraction,
    percentile_points,
    percentile_without,
    value_counts,
)

MAX_BROADCAST_SPREADS = 20_000


def groups_of(by_currency: bool) -> list[str]:
    return ["category", "currency"] if by_currency else ["category"]


def category_spreads(
    history: DataFrame, bridge: DataFrame, by_currency: bool = False
) -> DataFrame:
    """Size and 90th percentile of completed totals per category.

    Currencies are mixed unless ``by_currency`` is set. Only taxonomy names count, so
    the result has at most one row per name (and currency).
    """
    counts = spread_counts(history, bridge, by_currency)
    return percentile_points(counts, groups_of(by_currency), OUTLIER_QUANTILE)


def spread_counts(history: DataFrame, bridge: DataFrame, by_currency: bool = False) -> DataFrame:
    """How often each total occurs per category: a rollup that can be kept and added to."""
    known = bridge.filter(F.col("category").isin(*TAXONOMY))
    slim = reportable(history).select("id", "currency", "total_amount")
    return value_counts(by_category(slim, known), groups_of(by_currency), "total_amount")


def spread_view(spreads: DataFrame) -> DataFrame:
    keys = [c for c in ("category", "currency") if c in spreads.columns]
    return spreads.select(
        *keys, F.col("size").alias("sample_size"), F.col("percentile").alias("p90")
    )


def pairs_in_currency(pairs: DataFrame, spreads: DataFrame) -> DataFrame:
    """Pairs with the spread of their category in their own currency, a missing one too."""
    key = ["category", "code", "no_code"]
    coded = lambda rows: rows.withColumns(
        {"code": F.coalesce("currency", F.lit("")), "no_code": F.col("currency").isNull()}
    )
    rows, lookup = coded(pairs), coded(spreads).drop("currency")
    if fits(lookup, MAX_BROADCAST_SPREADS):
        return rows.join(F.broadcast(lookup), key)
    return salted_lookup(rows, lookup, key, "id").filter(F.col("size").isNotNull())


def with_floor(spreads: DataFrame) -> DataFrame:
    """Add the lowest percentile any receipt can meet as its benchmark.

    Leaving a receipt out lowers a percentile at most to that of its two lower
    neighbours. A handful of rows: one per taxonomy name (and currency).
    """
    lowest = F.col("percentile")
    if "out_a" in spreads.columns:
        without = between(
            F.col("out_a"), F.col("out_b"), fraction(F.col("size") - 1, OUTLIER_QUANTILE)
        )
        lowest = F.least(lowest, without)
    counted = F.when(F.col("size") >= OUTLIER_MIN_RECEIPTS, lowest)
    return spreads.withColumn("floor", F.min(counted).over(Window.partitionBy()))


def _limit(p90: Column) -> Column:
    return p90 * F.lit(Decimal(OUTLIER_MULTIPLE))


def above_floor(receipts: DataFrame, spreads: DataFrame) -> DataFrame:
    """The receipts that can be outliers at all: no benchmark lies below the floor."""
    lowest = F.broadcast(with_floor(spreads).agg(F.min("floor").alias("floor")))
    return receipts.join(lowest, F.col("total_amount") > _limit(F.col("floor"))).drop("floor")


def benchmark(candidates: DataFrame) -> DataFrame:
    """Per receipt the eligible category with the highest p90; a tie goes by name."""
    eligible = candidates.filter(
        (F.col("sample_size") >= OUTLIER_MIN_RECEIPTS) & (F.col("p90") > 0)
    )
    chosen = F.min_by(
        F.struct("category", "sample_size", "p90"), F.struct(-F.col("p90"), F.col("category"))
    )
    return eligible.groupBy("id", "total_amount").agg(chosen.alias("best")).select(
        "id", "total_amount", "best.category", "best.sample_size", "best.p90"
    )


def above_benchmark(candidates: DataFrame) -> DataFrame:
    """Receipts whose total is more than the multiple of their benchmark."""
    fired = benchmark(candidates).filter(F.col("total_amount") > _limit(F.col("p90")))
    return fired.select("id", "category", "sample_size", "p90")


def outliers(
    receipts: DataFrame,
    history: DataFrame,
    bridge: DataFrame,
    by_currency: bool = False,
    leave_self_out: bool = False,
) -> DataFrame:
    """Receipts far above what other receipts of their categories cost.

    With ``leave_self_out`` the receipts are part of the history themselves and each
    is compared with all the others; otherwise they must not be in it.
    """
    tested = receipts.filter(F.col("total_amount") > 0).select(
        "id", "total_amount", "currency", "status"
    )
    pairs = by_category(tested, bridge)
    spreads = category_spreads(history, bridge, by_currency)
    return compare(pairs, spreads, by_currency, leave_self_out)


def compare(
    pairs: DataFrame, spreads: DataFrame, by_currency: bool = False, leave_self_out: bool = False
) -> DataFrame:
    """Outliers among (id, total_amount, currency, status, category) rows."""
    spreads = with_floor(spreads)
    if by_currency:
        joined = pairs_in_currency(pairs, spreads)
    else:
        # At most one row per taxonomy name.
        joined = pairs.join(F.broadcast(spreads), "category")
    # No benchmark lies below the floor, so what this drops cannot be an outlier; what is
    # left for the aggregation per receipt is a small part of the rows.
    joined = joined.filter(F.col("total_amount") > _limit(F.col("floor")))
    sample, p90 = F.col("size"), F.col("percentile")
    if leave_self_out:
        counted = reportable_flag()
        sample = F.when(counted, sample - 1).otherwise(sample)
        without = percentile_without(cents(F.col("total_amount")), OUTLIER_QUANTILE)
        p90 = F.when(counted, without).otherwise(p90)
    return above_benchmark(
        joined.select("id", "total_amount", "category", sample.alias("sample_size"), p90.alias("p90"))
    )


def reportable_flag() -> Column:
    return (F.col("status") == "completed") & F.col("total_amount").isNotNull()


def outlier_reason(total: Column, currency: Column) -> Column:
    """The sentence for a fired outlier (columns category, sample_size, p90)."""
    return F.concat(
        F.lit("Total "),
        money_text(total, currency),
        F.lit(f" is more than {OUTLIER_MULTIPLE}x the "),
        money_text(F.col("p90"), currency),
        F.lit(" 90th percentile of "),
        F.col("sample_size").cast("string"),
        F.lit(" earlier "),
        F.col("category"),
        F.lit(" receipts."),
    )
