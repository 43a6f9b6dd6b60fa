"""Row life-cycle on append-only tables: status, ledger rows, seeds, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..schemas import PENDING, PRICES, RECEIPT_DEFAULTS, TOKEN_PRICES
from .joining import salted_lookup
from .pruning import with_maybe


def latest_status(events: DataFrame) -> DataFrame:
    """The current status of each receipt from its (id, status, updated_at) events.

    At the same moment the final status outranks ``pending``. An aggregate, so events
    are reduced before the shuffle and no receipt's events are gathered.
    """
    order = F.struct("updated_at", F.col("status") != PENDING, "status")
    return events.groupBy("id").agg(
        F.max_by("status", order).alias("status"), F.max("updated_at").alias("updated_at")
    )


def ledger_rows(requests: DataFrame) -> DataFrame:
    """One ledger row per call of each request.

    A request carries parallel arrays (model and the token counters) and its
    ``request_id``, which all its rows share because it is set before they are split.
    A request without calls writes nothing.
    """
    columns = ["model", *TOKEN_PRICES]
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return requests.select(
        "request_id", "receipt_id", "endpoint", "created_at", F.inline(zipped)
    )


def with_request_ids(requests: DataFrame, *unique: str) -> DataFrame:
    """Give each request an id computed from its own unique columns.

    Unlike a random id it is the same when a lost task runs again.
    """
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in unique]))
    return requests.withColumn("request_id", F.md5(text))


def seed_prices(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """The stored price list plus seed rows it has no (prefix, start) for."""
    names = [f.name for f in PRICES.fields]
    fresh = seed.select(*names).join(stored, ["model_prefix", "valid_from"], "left_anti")
    return stored.select(*names).unionByName(fresh.select(*names))


def to_schema(rows: DataFrame, schema: T.StructType, defaults: dict = RECEIPT_DEFAULTS) -> DataFrame:
    """Rows of an older, narrower table in today's shape: added columns get defaults."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def may_refer(rows: DataFrame, reference: str, deleted: DataFrame) -> DataFrame:
    """The rows, with ``maybe`` where the reference may be one of the deleted ids."""
    return with_maybe(rows, reference, deleted, "id")


def _forget(rows: DataFrame, reference: str, deleted: DataFrame) -> DataFrame:
    """Null out references to deleted ids.

    Rows without a reference, or with one that a filter of the deleted ids rules out, go straight through; the few
    others are joined. Many copies of one original are spread as well.
    """
    told = may_refer(rows, reference, deleted)
    gone = deleted.select(F.col("id").alias(reference), F.lit(True).alias("gone")).distinct()
    linked = salted_lookup(told.filter("maybe").drop("maybe"), gone, [reference], "id")
    kept = linked.withColumn(
        reference, F.when(F.col("gone").isNull(), F.col(reference))
    ).drop("gone")
    return told.filter("not maybe").drop("maybe").unionByName(kept)


def delete_receipts(
    receipts: DataFrame, bridge: DataFrame, calls: DataFrame, deleted: DataFrame
) -> dict[str, DataFrame]:
    """Remove receipts: their category pairs go, references to them become null."""
    survivors = receipts.join(deleted, "id", "left_anti")
    of_deleted = deleted.select(F.col("id").alias("receipt_id"))
    return {
        "receipts": _forget(survivors, "duplicate_of", deleted),
        "bridge": bridge.join(of_deleted, "receipt_id", "left_anti"),
        "calls": _forget(calls, "receipt_id", deleted),
    }
