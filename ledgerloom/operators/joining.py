"""Join helpers: size-checked broadcast and spreading of hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 0.001
HOT_CANDIDATES = 500
SKETCH_ITEMS = 10_000
SALTS = 64


def fits(small: DataFrame, max_rows: int) -> bool:
    """Whether a side may be broadcast: a bounded count, never a guess from statistics."""
    return small.limit(max_rows + 1).count() <= max_rows


def small_broadcast(side: DataFrame, max_rows: int) -> DataFrame:
    """The side, hinted for broadcast where it ``fits``."""
    return F.broadcast(side) if fits(side, max_rows) else side


def hot_hashes(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows.

    One pass over the key columns with a frequent-items sketch; at most
    ``HOT_CANDIDATES`` hashes reach the driver, however large the input. The list
    only decides how rows are spread, never which rows match.
    """
    found = (
        rows.select(F.xxhash64(*keys).alias("hash"))
        .agg(
            F.count("*").alias("total"),
            F.expr(f"approx_top_k(hash, {HOT_CANDIDATES}, {SKETCH_ITEMS})").alias("top"),
        )
        .first()
    )
    if not found or not found.top:
        return []
    floor = max(found.total * share, 2)
    return sorted(entry["item"] for entry in found.top if entry["count"] > floor)


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: str,
    extra: Column | None = None,
    hot: Sequence[int] = (),
    salts: int = SALTS,
) -> DataFrame:
    """Left join of ``rows`` to a much smaller ``lookup`` on equal keys, hot keys split.

    No job runs here: skewed partitions of ``rows`` are split at run time by adaptive
    execution. Where hot keys are known beforehand (``hot_hashes``), their rows are spread over
    ``salts`` sub-keys by ``spread_by`` instead, and only their lookup rows are repeated for each of
    them. Every row is kept. ``extra`` is a further condition on columns of both sides.
    """
    hot = list(hot)
    names = {k: f"_{k}" for k in keys}
    right = lookup.select(*[F.col(c).alias(names.get(c, c)) for c in lookup.columns])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(n) for k, n in names.items()])
    if extra is not None:
        same = same & extra
    if hot:
        spread = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        is_hot = lambda columns: F.coalesce(F.xxhash64(*columns).isin(hot), F.lit(False))
        rows = rows.withColumn("_row_salt", F.when(is_hot(names), spread).otherwise(0))
        right = right.withColumn(
            "_salt", F.explode(F.when(is_hot(names.values()), every).otherwise(F.array(F.lit(0))))
        )
        same = same & (F.col("_row_salt") == F.col("_salt"))
    return rows.join(right, same, "left").drop(*names.values(), "_row_salt", "_salt")
