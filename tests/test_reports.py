import datetime as dt
import random
import re
from decimal import Decimal

from ledgerloom.plans import insights

RECEIPT = (
    "id bigint, receipt_date date, total_amount decimal(12,2), total_eur decimal(12,2),"
    " currency string, status string"
)
D = dt.date


def frames(spark):
    rows = [
        (1, D(2026, 1, 1), "100.00", "100.00", "EUR", "completed"),
        (2, D(2026, 1, 31), "33.20", "33.20", "EUR", "completed"),
        (3, D(2026, 1, 15), "40.00", "36.90", "USD", "completed"),
        (4, D(2026, 1, 16), "5.00", None, None, "completed"),
        (5, D(2026, 2, 28), "7.00", None, None, "completed"),
        (6, D(2026, 3, 1), "9.00", "9.00", "EUR", "completed"),
        (7, D(2026, 1, 5), "9.00", "9.00", "EUR", "pending"),
        (8, D(2026, 1, 5), None, None, "EUR", "completed"),
    ]
    money = lambda x: None if x is None else Decimal(x)
    receipts = spark.createDataFrame(
        [(i, d, money(t), money(e), c, s) for i, d, t, e, c, s in rows], RECEIPT
    )
    bridge = spark.createDataFrame(
        [(1, "Food"), (1, "Health"), (2, "Food"), (4, "Food"), (6, "Food"), (7, "Food")],
        "receipt_id bigint, category string",
    )
    return receipts, bridge


def report(spark, first, last):
    receipts, bridge = frames(spark)
    periods = spark.createDataFrame([(1, first, last)], "period_id int, first date, last date")
    return insights.period_reports(periods, receipts, bridge).first()


def test_report_text(spark):
    lines = report(spark, D(2026, 1, 1), D(2026, 2, 28)).report.split("\n")
    assert lines[0] == "Period: 2026-01-01 to 2026-02-28 (inclusive)."
    start = lines.index("receipt exactly once, so they are the only lines that may be added up:")
    assert lines[start + 1 : start + 5] == [
        "- 2026-01: 133.20 EUR over 2 receipts",
        "- 2026-01: 40.00 USD over 1 receipt",
        "- 2026-01: 5.00 over 1 receipt",
        "- 2026-02: 7.00 over 1 receipt",
    ]
    start = lines.index("lines overlap and must never be summed into a total:")
    assert lines[start + 1 : start + 4] == [
        "- Food: 133.20 EUR over 2 receipts",
        "- Health: 100.00 EUR over 1 receipt",
        "- Food: 5.00 over 1 receipt",
    ]
    assert lines[-2:] == [
        "- 2026-01: 170.10 EUR over 3 receipts (1 receipt could not be converted and is left out)",
        "- 2026-02: 0.00 EUR over 0 receipts (1 receipt could not be converted and is left out)",
    ]


def test_no_eur_section_without_conversions(spark):
    assert "converted to EUR" not in report(spark, D(2026, 2, 1), D(2026, 2, 28)).report


def test_empty_and_reversed_periods(spark):
    assert report(spark, D(2030, 1, 1), D(2030, 2, 1)).report == insights.EMPTY_PERIOD
    row = report(spark, D(2026, 2, 1), D(2026, 1, 1))
    assert row.report is None and row.error == '"from" must not be later than "to".'
    receipts, bridge = frames(spark)
    assert insights.is_empty(insights.spending_summary(receipts, bridge, "2030-01-01", "2030-01-02"))
    assert not insights.is_empty(insights.spending_summary(receipts, bridge, "2026-01-01", "2026-01-02"))


def test_skewed_lookup_split_by_the_planner(spark):
    """Unhinted lookups leave skew to adaptive execution; the session turns that on."""
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def brute_sums(periods, rows, names):
    """Month and category sums per period: {(period, name, currency): [receipts, total, converted, eur]}."""
    months, categories = {}, {}
    for period, first, last in periods:
        for i, day, total, eur, currency, status in rows:
            if status != "completed" or total is None or day is None or not first <= day <= last:
                continue
            for found, key in [(months, day.replace(day=1))] + [(categories, c) for c in names.get(i, [])]:
                line = found.setdefault((period, key, currency), [0, 0, 0, 0])
                line[0] += 1
                line[1] += total
                line[2] += eur is not None
                line[3] += eur or 0
    return months, categories


def test_sums_of_any_periods_equal_brute_force(spark):
    rng = random.Random(8)
    day = lambda: D(2025, 1, 1) + dt.timedelta(days=rng.choice([0, 30, 31, 58, 364, 365, rng.randrange(800)]))
    money = lambda: Decimal(rng.randint(-999, 9999)) / 100
    rows = [
        (i, None if i % 17 == 0 else day(), None if i % 13 == 0 else money(), None if i % 5 == 0 else money(), rng.choice(["EUR", "USD", None]), rng.choice(["completed"] * 4 + ["failed"]))
        for i in range(300)
    ]
    names = {i: rng.sample(["Food", "Health", "Other"], rng.randrange(3)) for i in range(300)}
    periods = [(n, day() - dt.timedelta(days=rng.randrange(40)), day() + dt.timedelta(days=rng.randrange(60))) for n in range(40)]
    periods += [(90, D(1, 1, 1), D(9999, 12, 31)), (91, D(2025, 2, 1), D(2025, 2, 28)), (92, D(2030, 1, 1), D(2031, 1, 1)), (93, D(2020, 1, 1), D(2020, 2, 1))]
    months, categories = brute_sums(periods, rows, names)
    receipts = spark.createDataFrame(rows, RECEIPT)
    bridge = spark.createDataFrame([(i, c) for i, cs in names.items() for c in cs], "receipt_id bigint, category string")
    frame = spark.createDataFrame(periods, "period_id int, first date, last date")
    found = insights.months_in_periods(frame, insights.daily_totals(receipts)).collect()
    assert {(r.period_id, r.month, r.currency): [r.receipts, r.total, r.converted, r.total_eur] for r in found} == months
    found = insights.categories_in_periods(frame, insights.daily_category_totals(receipts, bridge)).collect()
    assert {(r.period_id, r.category, r.currency): [r.receipts, r.total] for r in found} == {k: v[:2] for k, v in categories.items()}


def test_rows_met_do_not_grow_with_the_period(spark):
    """A period of one day and one of ten years look up as many running sums of a category."""
    receipts, bridge = frames(spark)
    daily = insights.daily_category_totals(receipts, bridge)
    for first, last in ((D(2026, 1, 16), D(2026, 1, 16)), (D(2020, 1, 1), D(2029, 12, 31))):
        frame = spark.createDataFrame([(1, first, last)], "period_id int, first date, last date")
        found = insights.categories_in_periods(frame, daily)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian", plan) and found.count() <= 3
