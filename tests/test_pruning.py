import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle, pruning


@pytest.mark.parametrize("most_blocks", [pruning.MOST_BLOCKS, 1])
def test_no_row_that_has_a_key_is_ruled_out(spark, most_blocks):
    keys = spark.range(0, 5000, 7).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 6000).cast("string")).alias("ref"))
    told = pruning.with_maybe(rows, "ref", keys, "k", most_blocks)
    assert told.columns == ["id", "ref", "maybe"] and told.count() == 20_000
    have = told.join(keys.filter("k is not null").withColumnRenamed("k", "ref"), "ref", "left_semi")
    assert have.count() > 1000 and have.filter("not maybe").count() == 0
    assert told.filter("ref is null and maybe").count() == 0


def test_rows_that_go_on_are_near_those_that_match(spark):
    """100,000 references, a thousand of them to deleted ids: few more than a thousand reach the join."""
    deleted = spark.range(0, 100_000, 100).select(F.col("id").cast("string").alias("id"))
    rows = spark.range(100_000).select(F.col("id").alias("row"), F.col("id").cast("string").alias("duplicate_of"))
    told = lifecycle.may_refer(rows, "duplicate_of", deleted)
    plan = told.filter("maybe")._jdf.queryExecution().executedPlan().toString()
    exchanged = re.findall(r"Exchange hashpartitioning\(([^,]*)", plan)
    assert all("block" in e for e in exchanged) and "BroadcastHashJoin" in plan
    assert 1000 <= told.filter("maybe").count() <= 1000 * 4


def test_no_keys_rule_out_every_row(spark):
    rows = spark.range(10).select("id", F.col("id").cast("string").alias("ref"))
    none = spark.createDataFrame([], "id string")
    assert pruning.with_maybe(rows, "ref", none, "id").filter("maybe").count() == 0


def test_references_are_forgotten_exactly(spark):
    receipts = spark.createDataFrame(
        [(str(i), None if i % 5 == 0 else str(i % 40)) for i in range(400)], "id string, duplicate_of string"
    )
    bridge = spark.createDataFrame([(str(i), "Food") for i in range(400)], "receipt_id string, category string")
    calls = spark.createDataFrame([(i, str(i % 50) if i % 2 else None) for i in range(300)], "id int, receipt_id string")
    deleted = spark.createDataFrame([(str(i),) for i in range(0, 400, 3)] + [("1",), ("1",)], "id string")
    gone = {r.id for r in deleted.collect()}
    left = lifecycle.delete_receipts(receipts, bridge, calls, deleted)
    want = sorted((r.id, str(None if r.duplicate_of in gone else r.duplicate_of)) for r in receipts.collect() if r.id not in gone)
    assert sorted((r.id, str(r.duplicate_of)) for r in left["receipts"].collect()) == want
    want = sorted((r.id, str(None if r.receipt_id in gone else r.receipt_id)) for r in calls.collect())
    assert sorted((r.id, str(r.receipt_id)) for r in left["calls"].collect()) == want
    assert left["bridge"].count() == 400 - len(gone)
