import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.fx import with_eur

D = dt.date
RATES = [
    ("USD", D(2024, 3, 15), Decimal("0.91811")),
    ("USD", D(2024, 3, 18), Decimal("0.92")),
    ("USD", D(2026, 9, 22), Decimal("0.85")),
    ("JPY", D(2024, 3, 15), Decimal("0.006")),
]


def convert(spark, currency, day, total="10.00"):
    total = None if total is None else Decimal(total)
    rows = spark.createDataFrame(
        [(1, currency, day, total)],
        "id bigint, currency string, receipt_date date, total_amount decimal(12,2)",
    )
    rates = spark.createDataFrame(RATES, "currency string, rate_date date, rate decimal(18,8)")
    row = with_eur(rows, rates, F.lit(D(2026, 10, 1))).first()
    assert row.currency == currency
    return row.fx_rate, row.fx_date, row.total_eur


def test_eur_needs_no_rate(spark):
    assert convert(spark, " eur", D(2026, 8, 12)) == (1, D(2026, 8, 12), Decimal("10.00"))
    assert convert(spark, "EUR", None) == (1, D(2026, 10, 1), Decimal("10.00"))


def test_weekend_uses_the_friday_before(spark):
    expected = (Decimal("0.91811"), D(2024, 3, 15), Decimal("9.18"))
    assert convert(spark, "usd", D(2024, 3, 16)) == expected


def test_days_after_the_last_rate_and_undated_use_the_latest(spark):
    latest = (Decimal("0.85"), D(2026, 9, 22), Decimal("8.50"))
    assert convert(spark, "USD", D(2026, 12, 31)) == latest
    assert convert(spark, "USD", None) == latest
    assert convert(spark, "JPY", D(2025, 1, 1))[1] == D(2024, 3, 15)


def test_nothing_to_convert(spark):
    nothing = (None, None, None)
    assert convert(spark, "XXX", D(2026, 8, 12)) == nothing
    assert convert(spark, None, D(2026, 8, 12)) == nothing
    assert convert(spark, "", D(2026, 8, 12)) == nothing
    assert convert(spark, "USD", D(2024, 3, 16), None) == nothing
    assert convert(spark, "USD", D(2020, 1, 1)) == nothing


def test_cents_are_rounded_after_multiplying(spark):
    assert convert(spark, "USD", D(2024, 3, 15), "4.51")[2] == Decimal("4.14")
