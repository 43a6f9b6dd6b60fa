"""Receipts with their categories, and the category dimension itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ID_BUCKETS = 1024


def named_bridge(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """(receipt_id, category_id) pairs with the category name instead of its id."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return bridge.join(names, "category_id").select("receipt_id", "category")


def category_lists(bridge: DataFrame) -> DataFrame:
    """One sorted name list per receipt; a receipt has at most the taxonomy's names."""
    return bridge.groupBy(F.col("receipt_id").alias("id")).agg(
        F.array_sort(F.collect_set("category")).alias("categories")
    )


def with_categories(receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every receipt with its name list, empty when it has none."""
    empty = F.array().cast("array<string>")
    return receipts.join(category_lists(bridge), "id", "left").withColumn(
        "categories", F.coalesce("categories", empty)
    )


def by_category(receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per receipt and category: overlapping on purpose."""
    pairs = bridge.select(F.col("receipt_id").alias("id"), "category")
    return receipts.join(pairs, "id")


def bridge_from_lists(receipts: DataFrame) -> DataFrame:
    """Trimmed, non-blank, distinct (receipt_id, category) pairs of ``categories`` lists."""
    names = receipts.select(F.col("id").alias("receipt_id"), F.explode("categories").alias("name"))
    trimmed = names.select("receipt_id", F.trim("name").alias("category"))
    return trimmed.filter(F.length("category") > 0).dropDuplicates()


def extend_dimension(categories: DataFrame, bridge: DataFrame) -> DataFrame:
    """The dimension plus every name the bridge has and it lacks, with new ids.

    New ids run on from the largest old one without gaps. Names are numbered in
    hash buckets and the buckets are stacked, so no single task orders all names.
    """
    last = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    numbered = _placed(_new_names(categories, bridge)).select((last + F.col("place")).cast("int").alias("id"), "name")
    return categories.select("id", "name").unionByName(numbered)


def _new_names(categories: DataFrame, bridge: DataFrame) -> DataFrame:
    return bridge.select(F.col("category").alias("name")).distinct().join(categories, "name", "left_anti")


def _placed(names: DataFrame) -> DataFrame:
    """Names with a ``place`` from 1, without a task that orders all of them."""
    fresh = names.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(ID_BUCKETS)))
    stacked = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fresh.groupBy("bucket").agg(F.count("*").alias("names"))
    offsets = sizes.select(
        "bucket", F.coalesce(F.sum("names").over(stacked), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("name"))
    return fresh.join(offsets, "bucket").select("name", (F.col("offset") + place).alias("place"))


#: Ids that a batch may give: its own range starts at its number times this.
BATCH_IDS = 1 << 32


def reserved_ids(categories: DataFrame, bridge: DataFrame, batch: int) -> DataFrame:
    """(id, name) of the names that earlier batches lack, from the range of ids that belongs to the batch.

    A batch looks only at earlier ones and writes only its own range, so batches that run again, in any order, give the same
    ids, and no two batches can give one id to two names.
    """
    placed = _placed(_new_names(categories, bridge))
    return placed.select((F.lit(batch * BATCH_IDS) + F.col("place")).cast("bigint").alias("id"), "name")


def first_ids(stored: DataFrame) -> DataFrame:
    """One id per name from the rows of several batches: that of the earliest."""
    return stored.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")


def bridge_ids(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """The bridge with category ids, each pair once."""
    ids = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return bridge.join(ids, "category").select("receipt_id", "category_id").dropDuplicates()
