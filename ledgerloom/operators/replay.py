"""Outliers as they stood on the day each receipt came in.

The 90th percentile of "everything completed before this day" is needed for every
category and day. Two forms:

- exact: all (category, day) ranks are searched at once, six bits of the value a round. A round counts, per
  part of the value range that some rank lies in, how many totals of each of its 64 sub-parts came in before each day:
  running sums along the days, which Spark streams (and spills) in sorted order. A rank goes on in the
  sub-part where the running sums pass it. No round holds a day-by-value table, and what a task keeps of a group is 64 counters,
  however long the calendar.
- sketched: one mergeable quantile sketch per category and day; sketches of aligned blocks of 1, 2, 4, ... days are merged once, and a
  day meets the few blocks that make up all days before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import OUTLIER_QUANTILE, TAXONOMY
from ..sources.sinks import written
from .categories import by_category
from .filters import reportable
from .percentiles import between, fraction, rank_below, value_counts
from .spreads import above_benchmark

#: Bits of the value that one round settles; 64 running sums are still one generated projection.
BITS = 6
PARTS = 1 << BITS
#: Of a sketch: the rank of its percentile is within about 1.3 % of the asked one, 99 times of 100.
SKETCH_K = 200


def arrival_day() -> Column:
    """The UTC day a receipt came in, as a day number."""
    return F.unix_date(F.to_date("created_at")).alias("day")


def categorised(history: DataFrame, bridge: DataFrame) -> DataFrame:
    known = bridge.filter(F.col("category").isin(*TAXONOMY))
    slim = reportable(history).select("id", "total_amount", arrival_day())
    return by_category(slim, known)


def daily_counts(history: DataFrame, bridge: DataFrame) -> DataFrame:
    """How often each total occurs per category and day of arrival."""
    return value_counts(categorised(history, bridge), ["category", "day"], "total_amount")


# exact -----------------------------------------------------------------------------------


def targets_of(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The two ranks to look up for every asked (category, day) that has a history."""
    per_day = counts.groupBy("category", "day").agg(F.sum("n").alias("n"), F.lit(1).alias("counts"))
    asking = asked.select(
        "category", "day", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("counts")
    )
    sized = per_day.unionByName(asking).withColumn("size", F.sum("n").over(_days_before("category")))
    low = rank_below(F.col("size"), OUTLIER_QUANTILE)
    ranks = F.filter(F.array(low, low + 1), lambda r: r < F.col("size"))
    return sized.filter("counts = 0 and size > 0").select(
        "category", "day", "size", F.posexplode(ranks).alias("which", "rank"),
        F.lit(0).cast("bigint").alias("prefix"),
    )


def _days_before(*group: str):
    """On one day the asking row sorts before the counted one, so a day never sees itself."""
    return Window.partitionBy(*group).orderBy("day", "counts").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def narrow(targets: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """One round: the next six bits of each target's value, and its rank among the values that share them.

    ``counts`` has (category, day, value, n); the bits above ``shift`` + 6 are those of ``prefix``.
    """
    wanted = targets.select("category", "prefix").distinct()
    digit = F.shiftright("value", shift).bitwiseAND(F.lit(PARTS - 1))
    upto = [f"upto_{k}" for k in range(PARTS)]
    points = (
        counts.withColumns({"prefix": F.shiftright("value", shift + BITS), "digit": digit})
        .join(wanted, ["category", "prefix"], "left_semi")
        .groupBy("category", "prefix", "day")
        .agg(*[F.sum(F.when(F.col("digit") <= k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(upto)])
    )
    names = ("size", "which", "rank")
    none = {n: F.lit(None).cast(dict(targets.dtypes)[n]).alias(n) for n in names}
    rows = points.select("category", "prefix", "day", F.lit(1).alias("counts"), *none.values(), *upto).unionByName(
        targets.select("category", "prefix", "day", F.lit(0).alias("counts"), *names, *[F.lit(0).cast("bigint").alias(c) for c in upto])
    )
    before = _days_before("category", "prefix")
    summed = rows.select(
        "category", "prefix", "day", "counts", *names, F.array(*[F.sum(c).over(before) for c in upto]).alias("upto")
    ).filter("counts = 0")
    passed = summed.withColumn("digit", F.size(F.filter("upto", lambda n: n <= F.col("rank"))))
    below = F.when(F.col("digit") > 0, F.col("upto")[F.col("digit") - 1]).otherwise(0)
    return passed.select(
        "category", "day", "size", "which", (F.col("rank") - below).alias("rank"),
        (F.col("prefix") * PARTS + F.col("digit")).alias("prefix"),
    )


def spreads_before(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Size and percentile of all earlier days for every asked (category, day)."""
    counts = written(counts)
    ends = counts.agg(F.min("cents").alias("least"), F.max("cents").alias("most")).first()
    least = ends.least or 0
    rounds = max(1, -(-int((ends.most or 0) - least).bit_length() // BITS))
    values = counts.select("category", "day", (F.col("cents") - least).alias("value"), "n")
    targets = written(targets_of(counts, asked))
    for left in reversed(range(rounds)):
        targets = written(narrow(targets, values, left * BITS))
    value = lambda which: F.max(F.when(F.col("which") == which, F.col("prefix") + least))
    found = targets.groupBy("category", "day", "size").agg(
        value(0).alias("low"), value(1).alias("high")
    )
    share = fraction(F.col("size"), OUTLIER_QUANTILE)
    return found.select(
        "category",
        "day",
        F.col("size").alias("sample_size"),
        between(F.col("low"), F.col("high"), share).alias("p90"),
    )


# sketched --------------------------------------------------------------------------------


def daily_sketches(history: DataFrame, bridge: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of the totals per category and day: a rollup that can be kept and added to."""
    rows = categorised(history, bridge).filter(F.col("total_amount").isNotNull())
    total = F.col("total_amount").cast("double")
    return rows.groupBy("category", "day").agg(
        F.kll_sketch_agg_double(total, k).alias("sketch"), F.count("*").alias("n")
    )


def block_sketches(sketches: DataFrame, first: int, levels: int, k: int = SKETCH_K) -> DataFrame:
    """Sketches of aligned blocks of 2 ** level days, counted from the day ``first``.

    A day is in one block of every level, so its sketch is merged as often as there are levels. Sketches of a
    day that several batches have brought are merged here as well.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    spread = sketches.select("category", F.col("day") - first, level, "sketch", "n").toDF("category", "place", "level", "sketch", "n")
    block = F.expr("shiftright(place, level)").alias("block")
    return spread.groupBy("category", "level", block).agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n")
    )


def sketched_spreads_before(sketches: DataFrame, asked: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Size, sketch and approximate percentile of all earlier days for every asked (category, day).

    Days since the first one are a sum of powers of two; each is one block, which the day meets by equality.
    """
    ends = sketches.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    first, last = ends["first"] or 0, ends["last"] or 0
    levels = max(1, (last - first + 1).bit_length())
    blocks = block_sketches(sketches, first, levels, k)
    # Days after the last one see what the day after it sees.
    place = F.least(F.col("day"), F.lit(last + 1)) - first
    asks = asked.select("category", "day", place.alias("place")).distinct().filter("place > 0")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    asks = asks.select("category", "day", "place", level).filter("shiftright(place, level) % 2 = 1")
    asks = asks.withColumn("block", F.expr("cast(shiftright(place, level) - 1 as int)"))
    met = asks.join(blocks, ["category", "level", "block"])
    merged = met.groupBy("category", "day").agg(
        F.sum("n").alias("sample_size"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    p90 = F.kll_sketch_get_quantile_double("sketch", F.lit(float(OUTLIER_QUANTILE)))
    return merged.select("category", "day", "sample_size", p90.alias("p90"), "sketch")


# outliers --------------------------------------------------------------------------------


def replayed_outliers(receipts: DataFrame, history: DataFrame, bridge: DataFrame) -> DataFrame:
    """Receipts far above what had been completed before the day they came in.

    A day's own receipts do not count for each other: "earlier" means earlier days.
    """
    tested = receipts.filter(F.col("total_amount") > 0).select(
        "id", "total_amount", arrival_day()
    )
    pairs = by_category(tested, bridge)
    counts = daily_counts(history, bridge)
    spreads = spreads_before(counts, pairs.select("category", "day").distinct())
    candidates = pairs.join(spreads, ["category", "day"])
    return above_benchmark(
        candidates.select("id", "total_amount", "category", "sample_size", "p90")
    )
