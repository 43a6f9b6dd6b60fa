import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.asof import latest_before

ROW = "id int, k string, at bigint, since int"
FACT = "k string, since bigint, value int"


def brute(row, facts):
    mine = [f for f in facts if row[1] is not None and row[2] is not None and f[0] == row[1] and f[1] is not None and f[1] <= row[2]]
    return max(((f[1], f[2]) for f in mine), default=None)


@pytest.mark.parametrize("width,salts", [(1, 1), (10, 3), (10**15, 1), (7, 2)])
def test_every_row_gets_its_newest_fact(spark, width, salts):
    rng = random.Random(width + salts)
    moment = lambda: rng.choice([None, 0, -5, rng.randint(-60, 60), rng.randint(-10**14, 10**14)])
    name = lambda: rng.choice(["a", "b", "c", None])
    rows = [(i, name(), moment(), i % 3) for i in range(200)]
    facts = [(name(), moment(), rng.randrange(5)) for _ in range(60)]
    found = latest_before(
        spark.createDataFrame(rows, ROW).repartition(3), spark.createDataFrame(facts, FACT), ["k"], "at", "since", width, salts
    )
    assert found.columns == ["id", "k", "at", "since", "fact"]
    got = found.collect()
    assert len(got) == 200
    for r in got:
        assert tuple(r)[:4] == rows[r.id]
        assert (tuple(r.fact) if r.fact else None) == brute(rows[r.id], facts)


def test_two_keys_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a", 5, 0)], ROW)
    none = spark.createDataFrame([], FACT)
    assert latest_before(rows, none, ["k"], "at", "since", 10).first().fact is None
    assert latest_before(rows.limit(0), none, ["k"], "at", "since", 10).count() == 0
    facts = spark.createDataFrame([("a", 1, 3, 9), ("a", 2, 4, 8)], "k string, id int, since bigint, value int")
    assert latest_before(rows, facts, ["k", "id"], "at", "since", 2).first().fact == (3, 9)


def test_no_row_per_step_of_time_and_no_range_join(spark):
    """Two facts ten billion steps apart; the plan sorts, and nothing is generated for the gap."""
    rows = spark.createDataFrame([(1, "a", 10**10 + 1, 0), (2, "a", 10**10 - 1, 0)], ROW)
    facts = spark.createDataFrame([("a", 0, 1), ("a", 10**10, 2)], FACT)
    found = latest_before(rows, facts, ["k"], "at", "since", 1000)
    assert {r.id: r.fact.value for r in found.collect()} == {1: 2, 2: 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
    assert re.search(r"hashpartitioning\(k#\d+, _bucket#\d+L?, _salt", plan)


def test_a_hot_key_is_spread(spark):
    rows = spark.range(1000).select(F.col("id").cast("int"), F.lit("a").alias("k"), F.col("id").alias("at"), F.lit(0).alias("since"))
    facts = spark.createDataFrame([("a", 0, 1)], FACT)
    found = latest_before(rows, facts, ["k"], "at", "since", 100, salts=8)
    assert found.filter("fact.value = 1").count() == 1000
