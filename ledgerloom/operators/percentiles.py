"""Exact interpolated percentiles of money columns, without one task per group.

Amounts are whole cents with a fixed number of digits. They are first counted per
value (map-side combined), then ranked in two steps: by the high digits, and inside
the one or two high-digit buckets that hold the wanted ranks by the low digits. No
step sorts more than about two million distinct values of a group, whatever the
number of rows, because a ``decimal(12,2)`` has no more of them per step.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_CENTS = 1_000_000


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def value_counts(rows: DataFrame, groups: list[str], amount: str) -> DataFrame:
    known = rows.filter(F.col(amount).isNotNull())
    return known.groupBy(*groups, cents(F.col(amount)).alias("cents")).agg(
        F.count("*").alias("n")
    )


def _hit(ranks: Column, below: Column, upto: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= below) & (r < upto))


def values_at(
    counts: DataFrame, groups: list[str], wanted: Callable[[Column], Column]
) -> DataFrame:
    """The values at some 0-based ranks of each group: groups, size, rank, cents.

    ``wanted`` maps the group size to an array of ranks; ranks outside the group are
    left out.
    """
    bucket = F.expr(f"cents div {BUCKET_CENTS}")
    upto = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    coarse = (
        counts.groupBy(*groups, bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("size", F.sum("n").over(Window.partitionBy(*groups)))
    )
    picked = (
        coarse.withColumn("below", F.col("upto") - F.col("n"))
        .withColumn("ranks", _hit(wanted(F.col("size")), F.col("below"), F.col("upto")))
        .filter(F.size("ranks") > 0)
        .select(
            *[F.col(g).alias(f"_{g}") for g in groups],
            F.col("bucket").alias("_bucket"),
            "below",
            "size",
            "ranks",
        )
    )
    # Null-safe throughout: a plain equality would add a filter to this use of the
    # counts alone, and the counts would be computed twice instead of reused.
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups],
        bucket.eqNullSafe(F.col("_bucket")),
    )
    inner = Window.partitionBy(*groups, "_bucket").orderBy("cents").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fine = (
        counts.join(picked, same)
        .withColumn("upto", F.col("below") + F.sum("n").over(inner))
        .withColumn("ranks", _hit(F.col("ranks"), F.col("upto") - F.col("n"), F.col("upto")))
    )
    return fine.select(*groups, "size", F.explode("ranks").alias("rank"), "cents")


def position(size: Column, q: str) -> Column:
    """Exact decimal position of the ``q`` percentile among ``size`` sorted values."""
    return F.lit(Decimal(q)) * (size - 1).cast("decimal(18,0)")


def rank_below(size: Column, q: str) -> Column:
    return F.floor(position(size, q)).cast("bigint")


def fraction(size: Column, q: str) -> Column:
    return position(size, q) - F.floor(position(size, q))


def between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; a missing upper neighbour means the share is zero."""
    low = low.cast("decimal(14,0)")
    step = F.coalesce(high.cast("decimal(14,0)") - low, F.lit(Decimal(0)))
    return ((low + share * step) * F.lit(Decimal("0.01"))).cast("decimal(20,4)")


def percentile_points(counts: DataFrame, groups: list[str], q: str) -> DataFrame:
    """Per group: size, the percentile, and what leaving one value out needs.

    Removing one value from a sorted group moves the percentile only among three
    neighbours (``out_a``, ``out_b``, ``out_c``), so one row per group is enough to
    answer "the percentile of everything but this receipt" for every receipt.
    """
    size = F.col("size")
    k, less = rank_below(size, q), rank_below(size - 1, q)

    def wanted(n: Column) -> Column:
        low, out = rank_below(n, q), rank_below(n - 1, q)
        return F.array_distinct(F.array(low, low + 1, out, out + 1, out + 2))

    def value(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("cents")))

    points = values_at(counts, groups, wanted).groupBy(*groups, "size").agg(
        value(k).alias("low"),
        value(k + 1).alias("high"),
        value(less).alias("out_a"),
        value(less + 1).alias("out_b"),
        value(less + 2).alias("out_c"),
    )
    return points.withColumn(
        "percentile", between(F.col("low"), F.col("high"), fraction(size, q))
    )


def percentile_without(value_cents: Column, q: str) -> Column:
    """The group's percentile once one row with this value is removed."""
    a, b, c = F.col("out_a"), F.col("out_b"), F.col("out_c")
    low = F.when(value_cents <= a, b).otherwise(a)
    high = F.when(value_cents <= b, c).otherwise(b)
    return between(low, high, fraction(F.col("size") - 1, q))
