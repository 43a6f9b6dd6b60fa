"""Ledger, source columns and category ids of the intake; batches that run again."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.categories import BATCH_IDS, first_ids, reserved_ids
from ledgerloom.plans.intake import take_in
from tests.test_intake import extraction_json

CALL = "struct<model: string, input_tokens: int, output_tokens: int, cache_read_input_tokens: int, cache_creation_input_tokens: int>"
RESPONSE = f"id string, raw_response string, stop_reason string, created_at timestamp, calls array<{CALL}>"
PENDING = (
    "id string, raw_text string, prompt_used string, status string, source_type string, source_filename string,"
    " source_bytes int, created_at timestamp, updated_at timestamp"
)


def at(hour):
    return dt.datetime(2026, 8, 20, hour)


def rates(spark):
    return spark.createDataFrame(
        [("USD", dt.date(2026, 8, 1), Decimal("0.5"))], "currency string, rate_date date, rate decimal(18,8)"
    )


def batch(spark, *rows):
    return spark.createDataFrame([(i, raw, stop, at(h), calls) for i, h, raw, stop, calls in rows], RESPONSE)


def test_the_ledger_has_the_calls_of_failed_responses_too(spark, tmp_path):
    root = str(tmp_path)
    rows = batch(
        spark,
        ("a", 5, extraction_json(), "end_turn", [("m", 1, 2, 3, 4), ("m", 5, 6, 7, 8)]),
        ("b", 6, None, "refusal", [("n", 9, 0, 0, 0)]),
        ("c", 6, "{broken", "end_turn", []),
        ("d", 7, None, "end_turn", None),
    )
    pending = spark.createDataFrame(
        [("a", None, "read it", "pending", "pdf", "a.pdf", 900, at(1), at(1)), ("b", "milk 3.00", "read it", "pending", "text", None, None, at(2), at(2))],
        PENDING,
    )
    take_in(rows, rates(spark), root, 0, pending)
    ledger = spark.read.parquet(f"{root}/calls").orderBy("receipt_id", "input_tokens").collect()
    assert [(r.receipt_id, r.endpoint, r.model, r.input_tokens, r.cache_creation_input_tokens) for r in ledger] == [
        ("a", "pdf", "m", 1, 4), ("a", "pdf", "m", 5, 8), ("b", "text", "n", 9, 0),
    ]
    assert len({r.request_id for r in ledger}) == 2 and ledger[0].request_id == ledger[1].request_id
    assert all(r.call_day == dt.date(2026, 8, 20) for r in ledger)
    stored = {r.id: r for r in spark.read.parquet(f"{root}/receipts").collect()}
    assert {i: r.status for i, r in stored.items()} == {"a": "completed", "b": "failed", "c": "failed", "d": "failed"}
    a, b, c = stored["a"], stored["b"], stored["c"]
    assert (a.source_type, a.source_filename, a.source_bytes, a.raw_text, a.prompt_used) == ("pdf", "a.pdf", 900, None, "read it")
    assert (a.created_at, a.updated_at) == (at(1), at(5))
    assert (b.source_type, b.raw_text, b.created_at, b.updated_at) == ("text", "milk 3.00", at(2), at(6))
    assert (c.source_type, c.prompt_used, c.created_at, c.updated_at) == ("text", None, at(6), at(6))


def with_categories(*names):
    return extraction_json(categories=list(names), line_items=[])


def ids_of(spark, root):
    return {(r.name, r.id) for r in spark.read.parquet(f"{root}/categories").collect()}


def test_batches_that_run_again_in_any_order_keep_ids(spark, tmp_path):
    root = str(tmp_path)
    batches = [
        batch(spark, ("a", 1, with_categories("Food", "Health"), "end_turn", None)),
        batch(spark, ("b", 2, with_categories("Food", "Leisure"), "end_turn", None)),
        batch(spark, ("c", 3, with_categories("Leisure", "Other"), "end_turn", None)),
    ]
    for number, rows in enumerate(batches):
        take_in(rows, rates(spark), root, number)
    first = ids_of(spark, root)
    assert {n for n, _ in first} == {"Food", "Health", "Leisure", "Other"} and len(first) == 4
    assert {(n, i // BATCH_IDS) for n, i in first} == {("Food", 0), ("Health", 0), ("Leisure", 1), ("Other", 2)}
    for number in (2, 0, 1, 0):
        take_in(batches[number], rates(spark), root, number)
        assert ids_of(spark, root) == first
    bridge = spark.read.parquet(f"{root}/bridge")
    named = bridge.join(spark.read.parquet(f"{root}/categories").select(F.col("id").alias("category_id"), "name"), "category_id")
    assert sorted((r.receipt_id, r.name) for r in named.collect()) == [
        ("a", "Food"), ("a", "Health"), ("b", "Food"), ("b", "Leisure"), ("c", "Leisure"), ("c", "Other"),
    ]


def test_a_changed_rerun_never_gives_one_id_to_two_names(spark):
    """Batch 0 runs again and now has a name that batch 1 had brought: two ids for it, the earlier counts."""
    shape = "id bigint, name string"
    none = spark.createDataFrame([], shape)
    bridge = lambda *names: spark.createDataFrame([(n,) for n in names], "category string")
    one = reserved_ids(none, bridge("Food", "Food"), 0)
    two = reserved_ids(one, bridge("Food", "Health"), 1)
    again = reserved_ids(none, bridge("Food", "Health", "Other"), 0)
    rows = again.unionByName(two).collect()
    assert len({r.id for r in rows}) == len(rows) == 4
    assert {r.name: r.id // BATCH_IDS for r in first_ids(again.unionByName(two)).collect()} == {"Food": 0, "Health": 0, "Other": 0}
    assert reserved_ids(none, bridge(), 3).count() == 0


def test_stored_calls_can_be_priced(spark, tmp_path):
    from ledgerloom.operators.pricing import price_calls
    from ledgerloom.sources.tables import Tables

    root = str(tmp_path)
    take_in(batch(spark, ("a", 5, "x", "refusal", [("m-a", 1, 2, 3, 4)])), rates(spark), root, 0)
    row = price_calls(spark.read.parquet(f"{root}/calls").withColumn("id", F.lit(1)), Tables(spark, "unused").prices()).first()
    assert (row.model_prefix, row.valid_from) == ("m-a", dt.date(2024, 1, 15))
