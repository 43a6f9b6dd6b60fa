"""Exact duplicates by a two-pass Bloom filter.

The first pass counts hashes into the cells of a blocked Bloom filter and keeps, as bitmaps,
the cells that were met at least twice. The second pass sends each row's digest through
the filter: rows whose cells are not all set are certainly alone and pass straight through;
only the others are shuffled, and grouped by their whole digest, so false alarms cost time and
never change a result.

Defined cases: a null text is the empty text; a null id sorts after every id; of rows that
repeat id and text, one is kept; an empty table gives an empty result; columns other than
the two named ones are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_SPACES, with_group, written

BLOCK_BITS = 32_768  # of one bitmap of Spark's bitmap functions: 4 KB
BITS_PER_ROW = 16
PROBES = 3
#: The filter is broadcast, so its size has a bound: 2**13 blocks are 32 MB. Beyond two
#: hundred million rows it lets more rows through to the shuffle; results stay the same.
MOST_BLOCKS = 1 << 13


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACES, " ")


def _cells(rows: DataFrame, blocks: int) -> DataFrame:
    """Block number and the bit positions inside it, all taken from the digest."""
    # 48 bits of the digest for the block, 15 bits for each probe.
    hexed = F.hex("digest")
    part = lambda start, digits: F.conv(F.substring(hexed, start, digits), 16, 10).cast("bigint")
    probes = [(part(13 + 4 * i, 4) % BLOCK_BITS).cast("int") for i in range(PROBES)]
    return rows.select(
        "*", (part(1, 12) % blocks).cast("int").alias("block"), F.array(*probes).alias("bits")
    )


def _repeated_cells(cells: DataFrame) -> DataFrame:
    """Bitmaps of the cells met more than once, one row per block that has any.

    Counts are summed before the shuffle, which carries cell numbers only.
    """
    counted = (
        cells.select("block", F.explode(F.array_distinct("bits")).alias("bit"))
        .groupBy("block", "bit")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    return counted.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def _bit_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), bit % 8) == 1


def duplicate_groups(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, digest (binary SHA-256)."""
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    digests = written(
        rows.select(F.col(key).alias("key"), digest.alias("digest"))
        .withColumn("place", F.monotonically_increasing_id())
    )
    total = digests.count()
    blocks = min(max(1, -(-total * BITS_PER_ROW // BLOCK_BITS)), MOST_BLOCKS)
    cells = _cells(digests, blocks)
    seen = F.broadcast(_repeated_cells(cells).withColumnRenamed("block", "seen_block"))
    every = [_bit_set(F.col("bitmap"), F.col("bits")[i]) for i in range(PROBES)]
    maybe = F.col("bitmap").isNotNull()
    for test in every:
        maybe = maybe & test
    tested = written(
        cells.join(seen, F.col("block") == F.col("seen_block"), "left").select(
            "key", "digest", "place", F.coalesce(maybe, F.lit(False)).alias("maybe")
        )
    )
    alone = tested.where(~F.col("maybe")).select(
        "key",
        F.col("key").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    suspects = tested.where("maybe")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "place")
    groups = suspects.groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("group_size")
    )
    grouped = with_group(suspects, written(groups), "digest", "group_size").select(
        "key",
        F.col("first.key").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("first.place")).alias("kept"),
        "digest",
    )
    return alone.unionByName(grouped)
