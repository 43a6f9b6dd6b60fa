import random
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import needles as N
from ledgerloom.operators import running as R


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(2)
    ranges = [(a, b) for a in range(9) for b in range(a, 12)]
    ranges += [tuple(sorted((rng.randrange(3_000_000), rng.randrange(3_000_000)))) for _ in range(60)]
    ranges += [(0, 0), (0, 2**21 - 1), (1, 2**21 - 2), (5, 4)]
    rows = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(ranges)], "n int, a int, b int")
    found = rows.select("n", F.explode(R.blocks_in(F.col("a"), F.col("b"))).alias("at")).select("n", "at.*").collect()
    return ranges, found


def test_blocks_make_up_the_range(blocks):
    ranges, found = blocks
    for n, (first, last) in enumerate(ranges):
        mine = sorted((r.block << r.level, (r.block + 1) << r.level) for r in found if r.n == n)
        assert len(mine) <= 2 * max(1, (last - first + 1).bit_length())
        if first > last:
            assert not mine
            continue
        assert mine[0][0] == first and mine[-1][1] == last + 1
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:]))


def test_a_place_is_in_one_block_of_every_level(spark):
    row = spark.range(1).select(*[R.block_at(F.lit(1000), F.lit(level)).alias(str(level)) for level in range(12)]).first()
    assert list(row) == [1000 >> level for level in range(12)]


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_running_sums_equal_brute_force(spark, width):
    rng = random.Random(5)
    groups = [("a", 1), ("b", None), (None, 2)]
    points = [(*rng.choice(groups), float(rng.randint(-20, 40)), rng.randint(1, 9), Decimal(rng.randint(-99, 99)) / 100) for _ in range(300)]
    asks = [(*g, place, kind, n) for n, (g, place, kind) in enumerate(
        (g, rng.choice([float(rng.randint(-30, 50)), 1e15, -1e9]), kind) for g in [*groups, ("none", 3)] for kind in (R.BELOW, R.UPTO) for _ in range(12)
    )]
    found = R.running_sums(
        spark.createDataFrame(points, "g string, h int, place double, n bigint, total decimal(12,2)").repartition(3),
        spark.createDataFrame(asks, "g string, h int, place double, kind int, ask int").repartition(2),
        ["g", "h"], "place", ["n", "total"], width,
    ).collect()
    assert len(found) == len(asks)
    for r in found:
        g, h, place, kind, _ = asks[r.ask]
        mine = [p for p in points if (p[0], p[1]) == (g, h) and (p[2] < place or (kind == R.UPTO and p[2] == place))]
        assert (r.n, r.total) == (sum(p[3] for p in mine), sum((p[4] for p in mine), Decimal(0)))


def test_running_sums_of_nothing(spark):
    points = spark.createDataFrame([], "g string, place double, n bigint")
    asks = spark.createDataFrame([("a", 1.0, R.UPTO, 5)], "g string, place double, kind int, ask int")
    assert [(r.ask, r.n) for r in R.running_sums(points, asks, ["g"], "place", ["n"], 10.0).collect()] == [(5, 0)]
    assert R.running_sums(asks.select("g", "place", F.lit(1).alias("n")), asks.limit(0), ["g"], "place", ["n"], 1.0).count() == 0


def test_no_task_sorts_more_than_a_bucket(spark):
    """The window over points is dealt by group and bucket; that over the group alone has one row a bucket."""
    points = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("place"), F.lit(1).alias("n"))
    asks = spark.createDataFrame([("a", 500.0, R.UPTO, 1)], "g string, place double, kind int, ask int")
    plan = R.running_sums(points, asks, ["g"], "place", ["n"], 10.0)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+, _bucket", plan) and not re.search("Nested|Cartesian|Python", plan)


# needles ---------------------------------------------------------------------------------

TEXTS = ["Corner Shop", "CORNER 100% shop", "corner", "é ÀÉ", "aaaa", "ab", "a", "", None, "x_y%z", "Corner Shop"]


@pytest.mark.parametrize("needle", ["corner", "ORN", "100% s", "é", "àé", "aa", "aaaaa", "a", "%", "_", "zzz", "", None, "rner shop!"])
def test_a_needle_finds_every_text_that_holds_it(spark, needle):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = N.holders(spark.createDataFrame([(needle,)], "needle string"), texts)
    want = {t for t in TEXTS if needle and t and needle.lower() in t.lower()}
    assert sorted(r.text for r in found.collect()) == sorted(want)


@settings(deadline=None, max_examples=5)
@given(st.lists(st.text("abAB ", max_size=6), min_size=1, max_size=30), st.lists(st.text("abAB ", max_size=4), min_size=1, max_size=20))
def test_needles_in_any_texts(spark, texts, needles):
    found = N.holders(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted((r.needle, r.text) for r in found.collect()) == sorted(
        {(n, t) for n in needles for t in texts if n and n.lower() in t.lower()}
    )


def test_ten_thousand_needles_meet_few_texts(spark):
    """Each needle is one of 20,000 merchants' own numbers; all merchants share a word."""
    texts = spark.range(20_000).select(F.concat(F.lit("Merchant "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("text"))
    needles = spark.range(10_000).select(F.substring(F.md5((F.col("id") * 2).cast("string")), 3, 8).alias("needle"))
    met = N.candidates(needles, texts)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
    candidates = met.count()
    held = N.holders(needles, texts)
    assert held.select("needle").distinct().count() == needles.distinct().count()
    # 200 million pairs of needle and text, of which one in several hundred is looked at.
    assert candidates < 20_000 * 10_000 / 300


def test_a_needle_goes_by_its_rarest_gram(spark):
    texts = spark.createDataFrame([(f"common {k}",) for k in range(50)] + [("common xyz",)], "text string")
    met = N.candidates(spark.createDataFrame([("common xyz",)], "needle string"), texts).collect()
    assert [r.text for r in met] == ["common xyz"]


