"""Streams that keep state next to the batch operators."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import duplicates, lifecycle
from ledgerloom.streaming import state

START = dt.datetime(2026, 3, 1)
EVENT = "id bigint, status string, updated_at timestamp"
RECEIPT = (
    "id bigint, merchant string, receipt_date date, total_amount decimal(12,2), currency string, status string, created_at timestamp"
)


def hours(n):
    return START + dt.timedelta(hours=n)


def put(spark, rows, shape, folder):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, shape):
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)


def folders(tmp_path):
    return (str(tmp_path / n) for n in ("in", "store", "checkpoint"))


def run_status(spark, source, root, checkpoint, **options):
    state.start_status(stream(spark, source, EVENT), root, checkpoint, **options).awaitTermination()
    return {(r.id, r.status, r.updated_at) for r in state.current_status(spark.read.parquet(f"{root}/status")).collect()}


def test_status_of_two_batches_equals_that_of_all_events(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.randrange(25), rng.choice(["pending", "completed", "failed"]), hours(rng.randrange(20))) for _ in range(150)]
    events += [(1, "pending", hours(30)), (1, "completed", hours(30)), (None, "failed", hours(1)), (2, "failed", None)]
    source, root, checkpoint = folders(tmp_path)
    put(spark, events[:80], EVENT, source)
    run_status(spark, source, root, checkpoint, lateness="2 days")
    put(spark, events[80:], EVENT, source)
    # A new query over the same checkpoint: the state comes back from it.
    found = run_status(spark, source, root, checkpoint, lateness="2 days")
    known = spark.createDataFrame([e for e in events if None not in e], EVENT)
    assert found == {(r.id, r.status, r.updated_at) for r in lifecycle.latest_status(known).collect()}
    before = spark.read.parquet(f"{root}/status").count()
    assert run_status(spark, source, root, checkpoint, lateness="2 days") == found
    assert spark.read.parquet(f"{root}/status").count() == before


def test_late_events_are_dropped_and_old_records_forgotten(spark, tmp_path):
    source, root, checkpoint = folders(tmp_path)
    options = {"lateness": "1 hour", "retention": "5 hours"}
    steps = [
        [(1, "completed", hours(0)), (2, "pending", hours(0))],
        [(3, "pending", hours(20))],
        # The watermark is at 19 hours: this is late, and id 1 has been forgotten.
        [(2, "failed", hours(1)), (1, "pending", hours(21))],
    ]
    for rows in steps:
        put(spark, rows, EVENT, source)
        found = run_status(spark, source, root, checkpoint, **options)
    assert found == {(1, "pending", hours(21)), (2, "pending", hours(0)), (3, "pending", hours(20))}


def run_copies(spark, source, root, checkpoint, **options):
    state.start_first_copies(stream(spark, source, RECEIPT), root, checkpoint, **options).awaitTermination()
    firsts = state.current_first_copies(spark.read.parquet(f"{root}/first_copies"))
    found = duplicates.linked(spark.read.schema(RECEIPT).parquet(source), firsts)
    return {(r.id, r.match_id, r.match_at) for r in found.collect()}


def submissions(seed, count):
    rng = random.Random(seed)
    day = dt.date(2026, 2, 1)
    return [
        (i, rng.choice(["Shop", " shop", "SHOP ", "Kiosk", "", None]), rng.choice([day, day, None]), rng.choice([Decimal("5.00"), Decimal("6.10"), None]),
         rng.choice(["EUR", None]), rng.choice(["completed", "completed", "pending"]), hours(rng.randrange(12)))
        for i in range(count)
    ]


def test_first_copies_of_two_batches_equal_the_replay_of_all(spark, tmp_path):
    rows = submissions(6, 160)
    random.Random(1).shuffle(rows)
    source, root, checkpoint = folders(tmp_path)
    put(spark, rows[:70], RECEIPT, source)
    run_copies(spark, source, root, checkpoint)
    put(spark, rows[70:], RECEIPT, source)
    found = run_copies(spark, source, root, checkpoint)
    whole = duplicates.replay_duplicates(spark.createDataFrame(rows, RECEIPT)).collect()
    assert found == {(r.id, r.match_id, r.match_at) for r in whole} and found


def test_copies_further_apart_than_retention_are_not_linked(spark, tmp_path):
    source, root, checkpoint = folders(tmp_path)
    day, options = dt.date(2026, 2, 1), {"lateness": "1 hour", "retention": "10 hours"}
    same = lambda i, at: (i, "Shop", day, Decimal("5.00"), "EUR", "completed", hours(at))
    other = (9, "Other", day, Decimal("1.00"), "EUR", "completed", hours(50))
    for rows in ([same(1, 0)], [same(2, 5)], [other], [same(3, 60)], [same(4, 61)]):
        put(spark, rows, RECEIPT, source)
        state.start_first_copies(stream(spark, source, RECEIPT), root, checkpoint, **options).awaitTermination()
    told = spark.read.parquet(f"{root}/first_copies").filter(F.col("dup_merchant") == "shop")
    assert sorted((r.match_id, r.match_at) for r in told.collect()) == [(1, hours(0)), (3, hours(60))]


def test_keys_share_rows_of_the_state_store(spark, tmp_path):
    """One call of Python per bucket, not per key; records of a bucket are forgotten one by one."""
    source, root, checkpoint = folders(tmp_path)
    options = {"lateness": "1 hour", "retention": "5 hours", "buckets": 3}
    steps = [
        [(i, "pending", hours(0)) for i in range(200)] + [(500, "failed", hours(9))],
        [(i, "completed", hours(9)) for i in range(0, 200, 2)],
        [(700, "pending", hours(14))],
    ]
    records = []
    for rows in steps:
        put(spark, rows, EVENT, source)
        query = state.start_status(stream(spark, source, EVENT), root, checkpoint, **options)
        query.awaitTermination()
        records += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(records) <= 3
    found = {(r.id, r.status, r.updated_at) for r in state.current_status(spark.read.parquet(f"{root}/status")).collect()}
    old = {(i, "pending", hours(0)) for i in range(1, 200, 2)}
    assert found == old | {(i, "completed", hours(9)) for i in range(0, 200, 2)} | {(500, "failed", hours(9)), (700, "pending", hours(14))}
