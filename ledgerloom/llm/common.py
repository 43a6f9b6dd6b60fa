"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import new_folder, written

__all__ = ["ASCII_SPACES", "bodies", "components", "folded", "held_out", "kept_and_body", "new_folder", "ranked", "release_memory", "table", "with_group", "words_of", "written"]

# The ASCII white space of the contracts, as a Java and RE2 class.
ASCII_SPACES = r"[\x20\x09-\x0D]+"

#: Labelled rows are learnt from only where this remainder of the id's checksum is not 1.
FOLD = 3


#: Lower case for A-Z, a space for every other ASCII character that is no letter or digit.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def release_memory() -> None:
    """Give back what this task no longer uses: a worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Whether a row belongs to the fold that is never learnt from; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLD == 1, F.lit(False))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with a dense ``rank`` from 0 in the given order, without a one-task window.

    Rows are sorted by range, written once, and numbered inside their partition; only one
    count per partition is gathered to shift the numbers. Ties must be told apart by ``order``.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count().collect()
    starts, total = [], 0
    for row in sorted(counts, key=lambda r: r.part):
        starts.append((row.part, total))
        total += row["count"]
    # One row per partition of the sort, so the broadcast does not grow with the rows.
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.withColumn("rank", F.col("_start") + inside).drop("_place", "_part", "_start")


#: Groups of more than this share of all rows are met by a broadcast instead of a shuffle.
HOT_GROUPS = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str = "size") -> DataFrame:
    """Inner join of ``rows`` on ``key`` with the stored ``groups``, one row per key, hot keys apart.

    ``size`` says how many of the rows a group has. Those with more than a thousandth of all are
    fewer than a thousand, whatever the input, so they are broadcast; the others are joined as Spark sees fit.
    """
    total = groups.agg(F.sum(size).alias("all")).first()["all"] or 0
    hot = F.col(size) > total / HOT_GROUPS
    names = [c for c in groups.columns if c != key]
    large, small = groups.where(hot), groups.where(~hot)
    packed = large.select(key, F.struct(*names).alias("_group"))
    tagged = rows.join(F.broadcast(packed), key, "left")
    met = tagged.where("_group is not null").select(*rows.columns, "_group.*")
    rest = tagged.where("_group is null").select(*rows.columns).join(small, key)
    return met.unionByName(rest.select(*met.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per linked node but the roots, where root
    is the smallest node that can be reached.

    Large-star and small-star steps in turn, each written to the shared folder, until the links are
    stars round the roots. Counting a node's links and finding its smallest neighbour are aggregations;
    a node with very many links is no hot task.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    links = written(edges.where("a <> b").select(high, low).distinct())
    mark = _mark(links)
    while mark[0]:
        both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("size")))
        large = written(
            with_group(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        least = written(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("size")))
        lower = with_group(large, least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = written(lower.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Count and checksum of a set of links."""
    seen = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
    return seen.n, seen["sum"]


def kept_and_body(documents: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` as a struct ``row``, and the text as bytes in ``body`` unless it is one of them."""
    row = F.struct(*keep).alias("row")
    return documents.select(row) if text in keep else documents.select(row, F.col(text).cast("binary").alias("body"))


def bodies(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    """The texts of a batch of ``kept_and_body``, as bytes."""
    if "body" in batch.schema.names:
        return batch.column("body").to_pylist()
    return pc.struct_field(batch.column("row"), text).cast(pa.binary()).to_pylist()
