import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import replay
from ledgerloom.operators.percentiles import values_at
from tests.test_percentiles import interpolated

START = dt.datetime(2020, 1, 1)


def history(spark, seed, days, count, names=("Food", "Health", "Leisure")):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        cents = rng.choice([rng.randint(-300, 3000), rng.randint(-10**11, 10**11), 777])
        rows.append((rng.choice(names), rng.choice([days[0], rng.choice(days)]), cents))
    counts = spark.createDataFrame(rows, "category string, day int, cents bigint")
    return rows, counts.groupBy("category", "day", "cents").agg(F.count("*").alias("n"))


@pytest.mark.parametrize("days", [[5], [0, 1, 2, 40], list(range(-20, 400, 7))])
def test_every_day_sees_all_earlier_days(spark, days):
    rows, counts = history(spark, len(days), days, 300)
    asked = [(c, d) for c in ("Food", "Health", "Other") for d in [*days, days[-1] + 1000]]
    found = replay.spreads_before(counts, spark.createDataFrame(asked, "category string, day int")).collect()
    want = {}
    for category, day in asked:
        earlier = [Decimal(v) / 100 for c, d, v in rows if c == category and d < day]
        if earlier:
            want[category, day] = (len(earlier), interpolated(earlier))
    assert {(r.category, r.day): (r.sample_size, r.p90) for r in found} == want


def test_no_history_no_spread(spark):
    none = spark.createDataFrame([], "category string, day int, cents bigint, n bigint")
    asked = spark.createDataFrame([("Food", 1)], "category string, day int")
    assert replay.spreads_before(none, asked).count() == 0


def test_rounds_are_sorted_running_sums_without_python(spark):
    _, counts = history(spark, 1, [1, 2, 3], 50)
    values = counts.select("category", "day", (F.col("cents") + 10**11).alias("value"), "n")
    targets = replay.targets_of(counts, spark.createDataFrame([("Food", 3)], "category string, day int"))
    plan = replay.narrow(targets, values, 36)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search("Python|Pandas|Arrow|Nested|Cartesian", plan)


def test_rows_of_a_round_do_not_grow_with_empty_days(spark):
    """The same counts over thirty and over thirty thousand days: equal answers, equal rows."""
    rows = [("Food", k, 100 * k, 1) for k in range(30)]
    answers = []
    for stretch in (1, 1000):
        counts = spark.createDataFrame([(c, d * stretch, v, n) for c, d, v, n in rows], "category string, day int, cents bigint, n bigint")
        asked = counts.select("category", "day").distinct()
        targets = replay.targets_of(counts, asked)
        assert targets.count() <= 2 * 30
        answers.append(sorted((r.sample_size, r.p90) for r in replay.spreads_before(counts, asked).collect()))
    assert answers[0] == answers[1]


def receipts(spark, count, days):
    rng = random.Random(9)
    rows = [
        (i, "completed", Decimal(rng.randint(1, 10**6)) / 100, START + dt.timedelta(days=rng.randrange(days), hours=5), rng.choice(["Food", "Health"]))
        for i in range(count)
    ]
    frame = spark.createDataFrame(rows, "id bigint, status string, total_amount decimal(12,2), created_at timestamp, category string")
    return rows, frame, frame.select(F.col("id").alias("receipt_id"), "category")


@pytest.mark.parametrize("batches", [1, 3])
def test_sketched_percentiles_are_near_the_exact_ones(spark, batches):
    rows, frame, bridge = receipts(spark, 4000, 100)
    parts = [replay.daily_sketches(frame.filter(F.col("id") % batches == b), bridge) for b in range(batches)]
    sketches = parts[0]
    for more in parts[1:]:
        sketches = sketches.unionByName(more)
    first = (START.date() - dt.date(1970, 1, 1)).days
    asked = [(c, first + d) for c in ("Food", "Health", "Other") for d in (0, 1, 7, 50, 63, 64, 100, 5000)]
    found = replay.sketched_spreads_before(sketches, spark.createDataFrame(asked, "category string, day int")).collect()
    seen = set()
    for r in found:
        earlier = [float(t) for _, _, t, at, c in rows if c == r.category and (at.date() - dt.date(1970, 1, 1)).days < r.day]
        assert r.sample_size == len(earlier) > 0
        rank = sum(v <= r.p90 for v in earlier) / len(earlier)
        assert abs(rank - 0.9) <= 0.03 + 1 / len(earlier)
        seen.add((r.category, r.day - first))
    assert {d for _, d in seen} >= {7, 50, 63, 64, 100, 5000} and all(d > 0 for _, d in seen)


def test_a_day_meets_few_blocks(spark):
    _, frame, bridge = receipts(spark, 500, 1000)
    sketches = replay.daily_sketches(frame, bridge)
    blocks = replay.block_sketches(sketches, 18262, 10)
    per_level = {r.level: r.blocks for r in blocks.groupBy("level").agg(F.countDistinct("block").alias("blocks")).collect()}
    assert set(per_level) == set(range(10)) and per_level[9] == 2
    assert blocks.agg(F.max(F.length("sketch")).alias("most")).first().most < 20_000


def test_exact_and_whole_table_percentiles_agree_after_the_last_day(spark):
    _, counts = history(spark, 4, list(range(12)), 500)
    asked = counts.select("category", F.lit(99).alias("day")).distinct()
    before = {r.category: r.sample_size for r in replay.spreads_before(counts, asked).collect()}
    whole = counts.groupBy("category", "cents").agg(F.sum("n").alias("n"))
    sizes = {r.category: r["size"] for r in values_at(whole, ["category"], lambda n: F.array(F.lit(0))).select("category", "size").distinct().collect()}
    assert before == sizes
