"""Sums over ranges without meeting the rows of a range.

- Blocks: a range of whole numbers (days) is the union of at most two aligned blocks of 1, 2, 4, ... numbers per size. Rows are
  summed per block once; a range meets its blocks by equality.
- Running sums: a lookup gets the sums of all points of its group up to its place. Points and lookups are
  sorted together inside buckets of the place, and the sums of all earlier buckets enter a bucket as one seed row, so no task sorts
  more of a group than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Blocks of up to 2 ** 21 days hold every day from year 1 to 9999.
LEVELS = 22
FIRST_DAY = "0001-01-01"


def day_place(day: Column) -> Column:
    """Days since the first day a date can have."""
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def blocks_in(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The (level, block) pairs that make up the places from ``first`` to ``last``, both included.

    A block of a level holds 2 ** level places. On every level the range, rounded inwards to whole blocks, may
    have one block at either end that is not half of a larger block inside the range.
    """
    down = lambda value, level: F.call_function("shiftright", value, level)

    def ends(level: Column) -> Column:
        begin = down(first + F.call_function("shiftleft", F.lit(1), level) - 1, level)
        end = down(last + 1, level)
        own = lambda odd, block: F.when((begin < end) & (odd % 2 == 1), F.struct(level.alias("level"), block.alias("block")))
        return F.array(own(begin, begin), own(end, end - 1))

    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), ends))
    return F.array_compact(pairs)


def block_at(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place, level)


# Order of rows at one place: the seed of the bucket, lookups of what is below the place, points, lookups that include it.
SEED, BELOW, POINT, UPTO = 0, 1, 2, 3


def running_sums(
    points: DataFrame, lookups: DataFrame, group: list[str], place: str, sums: list[str], width: float
) -> DataFrame:
    """Each lookup with the sums of its group's points up to its place.

    ``points`` has the group, place and summed columns; ``lookups`` has the group, place, ``kind`` (BELOW or UPTO)
    and columns of its own, which stay. Groups match null-safely; a group without points has sums of 0.
    """
    own = [c for c in lookups.columns if c not in (*group, place, "kind")]
    kinds = dict(lookups.dtypes)
    bucket = F.floor(F.col(place) / F.lit(width)).cast("bigint").alias("_bucket")
    zero = [F.lit(0).cast(points.schema[c].dataType).alias(c) for c in sums]
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in own]
    point_rows = points.select(*group, bucket, F.col(place), F.lit(POINT).alias("kind"), *sums, *nothing)
    lookup_rows = lookups.select(*group, bucket, F.col(place), "kind", *zero, *own)

    # One row per group and bucket that has points or lookups.
    coarse = point_rows.select(*group, "_bucket", *sums).unionByName(lookup_rows.select(*group, "_bucket", *sums).distinct())
    coarse = coarse.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(coarse.schema[c].dataType).alias(c) for c in sums]
    least = F.lit(None).cast(dict(point_rows.dtypes)[place]).alias(place)
    seeds = coarse.select(*group, "_bucket", least, F.lit(SEED).alias("kind"), *carried, *nothing)

    upto = Window.partitionBy(*group, "_bucket").orderBy(F.col(place).asc_nulls_first(), "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    every = seeds.unionByName(point_rows).unionByName(lookup_rows)
    summed = every.select(*group, place, "kind", *own, *[F.sum(c).over(upto).alias(c) for c in sums])
    return summed.filter(F.col("kind").isin(BELOW, UPTO))
