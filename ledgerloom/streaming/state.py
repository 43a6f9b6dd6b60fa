"""The current status of receipts and the first copy of each submission, kept as streams arrive.

Both keep one small record per key in Spark's state store, whatever the number of rows of a key, and tell only changes. Records are
read and stored by buckets of keys, because a call of Python per key would cost far more than the key's rows. A change is
stored under its micro-batch, so the row of the largest batch is the current one, and a batch that is repeated after a
failure replaces its own rows. Results equal those of the batch operators for all rows that are not late.

Late rows and forgetting: the watermark follows the newest event less ``lateness``. Rows behind it are dropped. A timer
removes a key's record once the watermark has passed its newest event by ``retention``; the key then starts anew with its next row.
So two copies that are further apart than ``retention`` are not linked, and what was told stays. For the status nothing is lost: any event
that is older than a removed record is late.

Rows without a time or a key are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.duplicates import KEY, complete_key, keyed
from ..schemas import COMPLETED, PENDING
from ..sources.sinks import write_table

#: Buckets of keys: a micro-batch reads and stores the records of each bucket that it has a row of. The number belongs to the
#: checkpoint; more buckets make small micro-batches over very many keys cheaper, and large ones dearer.
BUCKETS = 1 << 14
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Kept:
    """What is kept of one key: the ``better`` of its records; ``columns`` name a record's values."""

    columns: list[str]

    def better(self, old: tuple, new: tuple) -> tuple:
        raise NotImplementedError


class LatestStatus(_Kept):
    """At the same moment a final status outranks ``pending``, like in the batch form."""

    columns = ["status", "at"]

    def better(self, old: tuple, new: tuple) -> tuple:
        rank = lambda record: (record[1], record[0] != PENDING, record[0])
        return max(old, new, key=rank)


class FirstCopy(_Kept):
    """The first submission of a key by time, then id."""

    columns = ["id", "at"]

    def better(self, old: tuple, new: tuple) -> tuple:
        return min(old, new, key=lambda record: (record[1], record[0]))


def _changes(key: list[str], kept: _Kept, retention_ms: int):
    """Judges the new rows of one bucket of keys, which share a row of the state store; a changed record gives a row."""
    width, names = len(key), [*key, *kept.columns]

    def run(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Key and record, then the newest event of the key.
        old = {r[:width]: r[width:] for r in map(tuple, state.get[0])} if state.exists else {}
        records = dict(old)
        for part in parts if not state.hasTimedOut else ():
            keys, values = (zip(*[part[c].tolist() for c in columns]) for columns in (key, kept.columns))
            for name, value, at in zip(keys, values, part["at"].tolist()):
                known = records.get(name)
                if known is None:
                    records[name] = (*value, max(at, 0))
                else:
                    records[name] = (*kept.better(known[:-1], value), max(at, known[-1]))
        told = [(*name, *r[:-1]) for name, r in records.items() if name not in old or r[:-1] != old[name][:-1]]
        passed = state.getCurrentWatermarkMs()
        ends = {name: r[-1] // 1000 + retention_ms for name, r in records.items()}
        left = [(*name, *r) for name, r in records.items() if ends[name] > passed]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(min(end for end in ends.values() if end > passed))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=names)

    return run


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


@contextmanager
def _state_store(spark: SparkSession):
    """Queries that start here keep their state in RocksDB, outside the heap; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER_SETTING)
    spark.conf.set(PROVIDER_SETTING, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_SETTING, before)


def _start(
    rows: DataFrame, key: list[str], kept: _Kept, retention: str, shape: str, time: str, lateness: str,
    store: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, buckets: int,
) -> StreamingQuery:
    spark = rows.sparkSession
    dated = rows.filter(F.col(time).isNotNull()).withColumn("at", F.unix_micros(time)).withWatermark(time, lateness)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket")
    changes = dated.select("*", bucket).groupBy("_bucket").applyInPandasWithState(
        _changes(key, kept, _milliseconds(retention)), outputStructType=shape, stateStructType=f"records array<struct<{shape}, newest bigint>>",
        outputMode="update", timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    with _state_store(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_status(
    events: DataFrame, root: str, checkpoint: str, lateness: str = "1 day", retention: str = "30 days", trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Write changes of status (id, status, updated_at) of (id, status, updated_at) events under ``root``/status."""
    id_type = dict(events.dtypes)["id"]

    def store(rows: DataFrame, batch: int) -> None:
        write_table(rows.select("id", "status", F.timestamp_micros("at").alias("updated_at")), root, "status", batch)

    known = events.filter("id is not null and status is not null").select("id", "status", "updated_at")
    shape = f"id {id_type}, status string, at bigint"
    return _start(known, ["id"], LatestStatus(), retention, shape, "updated_at", lateness, store, checkpoint, trigger, buckets)


def current_status(rows: DataFrame) -> DataFrame:
    """The status of each receipt from stored changes (with their ``batch``)."""
    newest = F.max_by(F.struct("status", "updated_at"), F.col("batch").cast("bigint")).alias("row")
    return rows.groupBy("id").agg(newest).select("id", "row.*")


def start_first_copies(
    receipts: DataFrame, root: str, checkpoint: str, lateness: str = "1 day", retention: str = "365 days", trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Write the first completed receipt of each submission key, and every change of it, under ``root``/first_copies."""
    id_type = dict(receipts.dtypes)["id"]

    def store(rows: DataFrame, batch: int) -> None:
        named = rows.select(*KEY, F.col("id").alias("match_id"), F.timestamp_micros("at").alias("match_at"))
        write_table(named, root, "first_copies", batch)

    known = keyed(receipts.filter((F.col("status") == COMPLETED) & complete_key() & F.col("id").isNotNull()))
    key_types = ", ".join(f"{n} {dict(known.dtypes)[n]}" for n in KEY)
    return _start(
        known.select(*KEY, "id", "created_at"), KEY, FirstCopy(), retention, f"{key_types}, id {id_type}, at bigint", "created_at", lateness,
        store, checkpoint, trigger, buckets,
    )


def current_first_copies(rows: DataFrame) -> DataFrame:
    """The first copy of each key from stored changes (with their ``batch``): what ``duplicates.linked`` looks up."""
    newest = F.max_by(F.struct("match_id", "match_at"), F.col("batch").cast("bigint")).alias("row")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "row.*")
