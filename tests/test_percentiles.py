import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import percentiles as P


def interpolated(values, q="0.9"):
    values = sorted(values)
    place = Decimal(q) * (len(values) - 1)
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (place - low) * (values[high] - values[low])


def sample(seed, sizes):
    rng = random.Random(seed)
    kinds = [
        lambda: Decimal(rng.randint(-500, 500)) / 100,
        lambda: Decimal(rng.randint(0, 10**12 - 1)) / 100,
        lambda: Decimal(rng.choice([999999, 1000000, 1000001, 5])) / 100,
    ]
    return {f"g{i}": [kinds[i % 3]() for _ in range(n)] for i, n in enumerate(sizes)}


@pytest.mark.parametrize("q", ["0.9", "0.5", "1", "0"])
def test_percentile_is_exact(spark, q):
    groups = sample(3, [1, 2, 3, 10, 11, 50, 97, 101, 240])
    rows = spark.createDataFrame(
        [(g, v) for g, vs in groups.items() for v in vs], "g string, v decimal(12,2)"
    )
    points = P.percentile_points(P.value_counts(rows, ["g"], "v"), ["g"], q).collect()
    assert {r.g: r.size for r in points} == {g: len(v) for g, v in groups.items()}
    for r in points:
        assert r.percentile == interpolated(groups[r.g], q), r


def test_null_is_a_group_of_its_own(spark):
    rows = spark.createDataFrame(
        [(None, Decimal("1.00")), (None, Decimal("3.00")), ("EUR", Decimal("2.00")), ("EUR", None)],
        "g string, v decimal(12,2)",
    )
    points = P.percentile_points(P.value_counts(rows, ["g"], "v"), ["g"], "0.5").collect()
    assert {r.g: (r.size, r.percentile) for r in points} == {None: (2, 2), "EUR": (1, 2)}


def test_leaving_one_out_matches_recomputing(spark):
    groups = sample(5, [2, 3, 9, 10, 11, 12, 41, 60])
    listed = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows = spark.createDataFrame(listed, "g string, i int, v decimal(12,2)")
    points = P.percentile_points(P.value_counts(rows, ["g"], "v"), ["g"], "0.9")
    without = P.percentile_without(P.cents(F.col("v")), "0.9")
    for r in rows.join(points, "g").select("g", "i", without.alias("p")).collect():
        rest = [v for j, v in enumerate(groups[r.g]) if j != r.i]
        assert r.p == interpolated(rest), (r, rest)
