"""Rows that cannot match a small set of keys, told apart without a shuffle.

The keys set bits in a filter made of Spark's bitmap functions; it is broadcast, and a row whose bits are not all set certainly has
none of the keys. Rows that may have one go on to a real join, so the filter decides about cost only. Its size follows the number of
keys up to a bound; beyond it more rows go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 32_768  # of one bitmap of Spark's bitmap functions: 4 KB
BITS_PER_KEY = 16
PROBES = 2
#: 2 ** 13 blocks are 32 MB, which hold two hundred and fifty million bits.
MOST_BLOCKS = 1 << 13


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(BLOCK_BITS)).cast("int") for probe in range(1, PROBES + 1)]


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), bit % 8) == 1


def key_filter(keys: DataFrame, key: str, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, Column]:
    """Bitmaps (block, bitmap) of the bits that the keys set, and the number of blocks; no job runs here."""
    named = keys.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
    needed = F.ceil(F.count("*") * BITS_PER_KEY / BLOCK_BITS)
    blocks = named.agg(F.greatest(F.lit(1), F.least(needed, F.lit(most_blocks))).cast("bigint").alias("blocks")).scalar()
    bits = named.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    return bits.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")), blocks


def with_maybe(rows: DataFrame, column: str, keys: DataFrame, key: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``rows`` with ``maybe``: false where ``column`` is none of the keys for certain, null included."""
    bitmaps, blocks = key_filter(keys, key, most_blocks)
    # At most ``most_blocks`` rows of 4 KB.
    met = rows.withColumn("_block", _block(F.col(column), blocks)).join(
        F.broadcast(bitmaps.withColumnRenamed("block", "_block")), "_block", "left"
    )
    every = reduce(lambda a, b: a & b, [_is_set(F.col("bitmap"), bit) for bit in _bits(F.col(column))])
    maybe = F.coalesce(F.col(column).isNotNull() & F.col("bitmap").isNotNull() & every, F.lit(False))
    return met.withColumn("maybe", maybe).drop("_block", "bitmap")
