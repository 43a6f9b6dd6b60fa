import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import anomalies, duplicates, joining, spreads

RECEIPT = (
    "id string, merchant string, receipt_date date, total_amount decimal(12,2), currency string,"
    " status string, created_at timestamp"
)
DAY = dt.date(2026, 8, 12)


def receipt(id, merchant="Shop", day=DAY, total="4.50", currency="EUR", status="completed", hour=0):
    total = None if total is None else Decimal(total)
    return (id, merchant, day, total, currency, status, dt.datetime(2026, 8, 20, hour))


def matches(spark, batch, history):
    make = lambda rows: spark.createDataFrame(rows, RECEIPT)
    found = duplicates.snapshot_duplicates(make(batch), make(history)).collect()
    return {r.id: r.match_id for r in found}


def test_duplicate_key(spark):
    history = [
        receipt("old", "  SHOP ", hour=5),
        receipt("older", "shop", hour=2),
        receipt("failed", "shop", hour=1, status="failed"),
        receipt("none", "Shop", currency=None),
        receipt("tab", "\tB"),
    ]
    batch = [
        receipt("a"),
        receipt("b", currency=None),
        receipt("c", currency="USD"),
        receipt("d", total="4.51"),
        receipt("e", day=None),
        receipt("f", total=None),
        receipt("g", merchant="\t "),
        receipt("h", merchant=None),
        receipt("i", merchant="B"),
        receipt("j", merchant="\tb "),
    ]
    assert matches(spark, batch, history) == {"a": "older", "b": "none", "j": "tab"}


def test_all_copies_point_at_the_first(spark):
    rows = [receipt(str(i), hour=i) for i in range(4)] + [receipt("x", total="9.00")]
    found = duplicates.replay_duplicates(spark.createDataFrame(rows, RECEIPT)).collect()
    assert {r.id: r.match_id for r in found} == {"1": "0", "2": "0", "3": "0"}


def test_hot_group_is_salted_and_kept_whole(spark):
    rows = [receipt(f"hot{i:04d}", hour=i % 20) for i in range(1500)]
    rows += [receipt(f"pair{i // 2}-{i % 2}", merchant=f"m{i // 2}", hour=i % 2) for i in range(3000)]
    frame = spark.createDataFrame(rows, RECEIPT)
    assert len(joining.hot_hashes(duplicates.keyed(frame), duplicates.KEY)) >= 1
    found = {r.id: r.match_id for r in duplicates.replay_duplicates(frame).collect()}
    assert len(found) == 1499 + 1500
    assert {found[k] for k in found if k.startswith("hot")} == {"hot0000"}
    assert all(found[k] == k[:-1] + "0" for k in found if k.startswith("pair"))


def test_duplicate_sentence(spark):
    match_at = F.lit("2026-08-20 22:30:00").cast("timestamp")
    reason = anomalies.duplicate_reason(F.lit("earlier-receipt"), match_at)
    assert spark.range(1).select(reason.alias("r")).first().r == (
        "Same merchant, date and total as receipt earlier-receipt, submitted on 2026-08-20; "
        "possible duplicate submission."
    )


def outlier(spark, total, spread, currency="EUR"):
    total = None if total is None else Decimal(total)
    names = [s[0] for s in spread]
    pairs = spark.createDataFrame(
        [("1", total, currency, "pending", n) for n in names],
        "id string, total_amount decimal(12,2), currency string, status string, category string",
    ).filter("total_amount > 0")
    measured = spark.createDataFrame(
        [(c, n, Decimal(p)) for c, n, p in spread],
        "category string, size bigint, percentile decimal(20,4)",
    )
    fired = spreads.compare(pairs, measured).withColumn("currency", F.lit(currency))
    reason = spreads.outlier_reason(F.lit(total).cast("decimal(12,2)"), F.col("currency"))
    rows = fired.select(reason.alias("reason")).collect()
    return rows[0].reason if rows else None


def test_outlier_sentence(spark):
    assert outlier(spark, "450", [("Food", 30, "25")]) == (
        "Total 450.00 EUR is more than 4x the 25.00 EUR 90th percentile of 30 earlier Food receipts."
    )
    assert outlier(spark, "450", [("Food", 30, "25")], None) == (
        "Total 450.00 is more than 4x the 25.00 90th percentile of 30 earlier Food receipts."
    )


@pytest.mark.parametrize(
    "total, spread, named",
    [
        ("100", [("Food", 30, "25")], None),
        ("100.01", [("Food", 30, "25")], "Food"),
        ("450", [("Food", 7, "25")], None),
        ("450", [("Food", 8, "25")], "Food"),
        ("450", [("Food", 30, "0")], None),
        ("300", [("Food", 40, "25"), ("Electronics", 12, "400")], None),
        ("5000", [("Food", 40, "25"), ("Electronics", 12, "400")], "Electronics"),
        ("5000", [("Leisure", 40, "25"), ("Food", 12, "25")], "Food"),
        (None, [("Food", 30, "25")], None),
        ("-5", [("Food", 30, "25")], None),
    ],
)
def test_outlier_boundaries(spark, total, spread, named):
    reason = outlier(spark, total, spread)
    assert (reason is None) if named is None else (f"earlier {named} receipts" in reason)


def test_every_reason_is_joined(spark):
    columns = (
        "id string, receipt_date date, total_amount decimal(12,2), currency string,"
        " is_suspicious boolean, flag_reason string, match_id string, match_at timestamp"
    )
    matched = spark.createDataFrame(
        [("1", dt.date(2026, 8, 15), Decimal("450"), "EUR", False, "A steak at 450",
          "earlier", dt.datetime(2026, 8, 20, 9))],
        columns,
    )
    far = spark.createDataFrame(
        [("1", "Food", 30, Decimal("25"))],
        "id string, category string, sample_size bigint, p90 decimal(20,4)",
    )
    row = anomalies.united(anomalies.weekend_flags(matched), far).first()
    assert (row.is_suspicious, row.duplicate_of) == (True, "earlier")
    assert row.flag_reason == (
        "A steak at 450. Issued on a Saturday. Same merchant, date and total as receipt earlier, "
        "submitted on 2026-08-20; possible duplicate submission. Total 450.00 EUR is more than 4x "
        "the 25.00 EUR 90th percentile of 30 earlier Food receipts."
    )


def test_missing_and_unreconciled(spark):
    rows = spark.createDataFrame(
        [receipt("a", total=None), receipt("b", day=None), receipt("c", merchant=None, day=None),
         receipt("d", total="100")],
        RECEIPT,
    )
    assert {r.id: r.missing_reason for r in anomalies.missing_fields(rows).collect()} == {
        "a": "The total is missing.", "b": "The date is missing.",
    }
    items = spark.createDataFrame(
        [("b", Decimal("4.50")), ("d", Decimal("60")), ("d", Decimal("38.9"))],
        "receipt_id string, amount decimal(12,2)",
    )
    assert [r.id for r in anomalies.unreconciled(rows, items).collect()] == ["d"]


def test_replayed_outliers_match_recomputing(spark):
    import random

    from ledgerloom.operators.replay import replayed_outliers
    from tests.test_percentiles import interpolated

    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(400):
        # Wide range of magnitudes, many receipts on one day, some negative or uncounted.
        usual, large = rng.randint(-300, 3000), rng.randint(10**4, 10**11)
        cents = large if i % 17 == 0 else usual
        total = None if i % 37 == 0 else Decimal(cents) / 100
        status = "failed" if i % 29 == 0 else "completed"
        at = dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.choice([0, 3, rng.randint(0, 30)]), hours=i % 24)
        rows.append((str(i), "m", DAY, total, "EUR", status, at))
        pairs += [(str(i), c) for c in rng.sample(["Food", "Health", "Leisure"], rng.randint(0, 3))]
    receipts = spark.createDataFrame(rows, RECEIPT)
    bridge = spark.createDataFrame(pairs, "receipt_id string, category string")
    labels = {}
    for id, category in pairs:
        labels.setdefault(id, []).append(category)
    expected = {}
    for id, _, _, total, _, _, at in rows:
        if total is None or total <= 0:
            continue
        best = None
        for category in labels.get(id, []):
            earlier = [
                r[3] for r in rows
                if r[3] is not None and r[5] == "completed" and r[6].date() < at.date()
                and category in labels.get(r[0], [])
            ]
            if len(earlier) >= 8 and interpolated(earlier) > 0:
                found = (-interpolated(earlier), category, len(earlier))
                best = found if best is None else min(best, found)
        if best and total > -best[0] * 4:
            expected[id] = (best[1], best[2], -best[0])
    got = {
        r.id: (r.category, r.sample_size, r.p90)
        for r in replayed_outliers(receipts, receipts, bridge).collect()
    }
    assert got == expected and expected


@pytest.mark.parametrize("most", [spreads.MAX_BROADCAST_SPREADS, 0])
def test_outliers_within_their_currency(spark, monkeypatch, most):
    monkeypatch.setattr(spreads, "MAX_BROADCAST_SPREADS", most)
    rows = [receipt(f"e{i}", total="10") for i in range(9)]
    rows += [receipt(f"j{i}", total="5000", currency="JPY") for i in range(9)]
    rows += [receipt(f"n{i}", total="20", currency=None) for i in range(9)]
    history = spark.createDataFrame(rows, RECEIPT)
    tested = [("x", "50", "EUR"), ("y", "5000", "JPY"), ("z", "90", None), ("w", "70", None), ("u", "9", "USD")]
    batch = spark.createDataFrame(
        [receipt(i, total=t, currency=c, status="pending") for i, t, c in tested], RECEIPT
    )
    ids = [r[0] for r in rows] + [t[0] for t in tested]
    bridge = spark.createDataFrame([(i, "Food") for i in ids], "receipt_id string, category string")
    found = spreads.outliers(batch, history, bridge, by_currency=True).collect()
    assert {r.id: (r.sample_size, r.p90) for r in found} == {"x": (9, 10), "z": (9, 20)}
    mixed = spreads.outliers(batch, history, bridge).collect()
    assert mixed == []
