"""Backward as-of lookups: each row with the newest fact of its key at or before its time.

Rows and facts are sorted together by time, and the newest fact so far is carried along. Time is cut into buckets, so that a key with
very many rows is no single task; the newest fact of all earlier buckets enters a bucket as a seed. There is no row per
day or other step of time, so times may be as fine and as irregular as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

# Order at one moment: seeds first, then facts, then rows, which therefore see facts of their own moment.
SEED, FACT, ROW = 0, 1, 2


def latest_before(
    rows: DataFrame, facts: DataFrame, key: list[str], at: str, since: str, width: int, salts: int = 1
) -> DataFrame:
    """``rows`` with a struct ``fact``: the other columns of the newest fact, or null.

    ``at`` and ``since`` are whole numbers (days, microseconds); a bucket holds ``width`` of them. Of facts of one key and
    moment the largest counts. Rows with a null key or time get no fact and take no part in the sort; facts with one are
    ignored. With ``salts`` the rows of a key and bucket are spread over so many parts, each with the facts.
    """
    packed = F.struct(*[F.col(c) for c in facts.columns if c not in key]).alias("_fact")
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint").alias("_bucket")
    whole = lambda *names: reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    named = facts.filter(whole(*key, since)).select(*key, bucket(since), F.col(since).cast("bigint").alias("_time"), packed)
    own = F.struct(*[F.col(c) for c in rows.columns]).alias("_row")
    usable = rows.filter(whole(*key, at))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != at]), F.lit(salts)).cast("int").alias("_salt")
    row_kind, fact_kind = dict(usable.select(own).dtypes)["_row"], dict(named.dtypes)["_fact"]
    no_row, no_fact = F.lit(None).cast(row_kind).alias("_row"), F.lit(None).cast(fact_kind).alias("_fact")

    # The newest fact of each bucket, carried to the later buckets that have rows.
    newest = named.groupBy(*key, "_bucket").agg(F.max(F.struct("_time", "_fact")).alias("_last"))
    asked = usable.select(*key, bucket(at)).distinct()
    coarse = newest.unionByName(asked.withColumn("_last", F.lit(None).cast(dict(newest.dtypes)["_last"])))
    coarse = coarse.groupBy(*key, "_bucket").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    seeds = coarse.withColumn("_seed", F.last("_last", ignorenulls=True).over(earlier)).filter(F.col("_seed").isNotNull())

    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    seed_rows = seeds.select(*key, "_bucket", F.col("_seed._time").alias("_time"), F.lit(SEED).alias("_kind"), no_row, F.col("_seed._fact").alias("_fact"), every_salt)
    fact_rows = named.select(*key, "_bucket", "_time", F.lit(FACT).alias("_kind"), no_row, "_fact", every_salt)
    asking = usable.select(*key, bucket(at), F.col(at).cast("bigint").alias("_time"), F.lit(ROW).alias("_kind"), own, no_fact, salt)
    order = Window.partitionBy(*key, "_bucket", "_salt").orderBy("_time", "_kind", "_fact").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = F.last("_fact", ignorenulls=True).over(order).alias("fact")
    met = seed_rows.unionByName(fact_rows).unionByName(asking).select("_kind", "_row", carried)
    found = met.filter(F.col("_kind") == ROW).select("_row.*", "fact")
    alone = rows.filter(~whole(*key, at)).withColumn("fact", F.lit(None).cast(fact_kind))
    return found.unionByName(alone)
