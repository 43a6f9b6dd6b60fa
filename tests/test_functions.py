import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, numbers, text
from ledgerloom.operators.anomalies import weekend_reason, with_reasons


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "day, expected",
    [
        ("2026-08-15", "Issued on a Saturday."),
        ("2026-08-16", "Issued on a Sunday."),
        ("2026-08-13", None),
        (None, None),
        ("not-a-date", None),
        ("13/08/2026", None),
        ("2026-08", None),
        ("2026-02-30", None),
        ("2026-02-29", None),
        ("2026-13-01", None),
    ],
)
def test_weekend(spark, day, expected):
    column = F.lit(day).cast("string")
    assert one(spark, weekend_reason(dates.real_day(column))).c0 == expected


@pytest.mark.parametrize(
    "flag, base, reasons, expected_flag, expected",
    [
        (True, "A steak at 450.00 EUR", [None, "  "], True, "A steak at 450.00 EUR"),
        (False, None, [None], False, None),
        (True, "No stop here ", ["Issued on a Sunday."], True, "No stop here. Issued on a Sunday."),
        (True, "   ", ["Issued on a Saturday."], True, "Issued on a Saturday."),
        (False, None, [" first", "second! "], True, "first. second!"),
        (True, " Odd? ", ["x"], True, "Odd? x."),
    ],
)
def test_reason_union(spark, flag, base, reasons, expected_flag, expected):
    rows = spark.createDataFrame([(flag, base)], "is_suspicious boolean, flag_reason string")
    row = with_reasons(rows, *[F.lit(r).cast("string") for r in reasons]).first()
    assert (row.is_suspicious, row.flag_reason) == (expected_flag, expected)


def test_wording(spark):
    amount = F.lit(Decimal("133.2")).cast("decimal(12,2)")
    row = one(
        spark,
        text.money_text(amount, F.lit("EUR")),
        text.money_text(F.lit(Decimal("5")), F.lit(None).cast("string")),
        text.plural(F.lit(1), "receipt"),
        text.plural(F.lit(9), "receipt"),
        text.percent_text(F.lit(0.9166666)),
        text.points_text(F.lit(-0.25)),
        text.points_text(F.lit(0.0)),
        text.pad(F.lit("abc"), 5),
        text.pad(F.lit("abcdef"), 5),
        text.escape_wildcards(F.lit("100%_\\")),
    )
    assert list(row) == [
        "133.20 EUR", "5.00", "1 receipt", "9 receipts", "91.7%", "-25.0pp", "+0.0pp", "abc  ",
        "abcdef", "100\\%\\_\\\\",
    ]


def test_contains_is_literal(spark):
    row = one(
        spark,
        text.contains_ignoring_case(F.lit("Shop 100% Wool"), F.lit("100% w")),
        text.contains_ignoring_case(F.lit("Shop 1000 Wool"), F.lit("100%")),
        text.contains_ignoring_case(F.lit("Shop A"), F.lit("_")),
    )
    assert list(row) == [True, False, False]


def test_numbers(spark):
    row = one(
        spark,
        numbers.to_money(F.lit(4.505)),
        numbers.to_money(F.lit(99999999999.0)),
        numbers.ratio(F.lit(0), F.lit(0)),
        numbers.f1_score(F.lit(0.0), F.lit(0.0)),
        numbers.per_million(F.lit(Decimal("1.5000"))),
        numbers.valid_amount(F.lit(float("nan"))),
        numbers.valid_amount(F.lit(float("inf"))),
        numbers.valid_amount(F.lit(-1.0)),
        numbers.valid_amount(F.lit(0.0)),
    )
    assert list(row) == [
        Decimal("4.51"), None, 0.0, 0.0, Decimal("0.000002"), False, False, False, True,
    ]


def test_dates(spark):
    day = F.lit(dt.date(2026, 8, 5))
    row = one(spark, dates.month_key(day), dates.day_text(day), dates.before_next_day(day))
    assert list(row) == ["2026-08", "2026-08-05", dt.datetime(2026, 8, 6)]


def test_labels(spark):
    pack = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    row = one(
        spark,
        labels.merged(pack("Other", "Food"), pack("Health", "Food")),
        labels.in_taxonomy(pack("Food", "Dinners")),
        labels.in_taxonomy(pack()),
        labels.in_taxonomy(F.lit(None).cast("array<string>")),
        labels.same_labels(pack("a", "a"), pack("a")),
        labels.missing(pack("a", "a", "b"), pack("b")),
        labels.spurious(pack("a"), pack("b", "a")),
    )
    assert list(row) == [
        ["Food", "Health", "Other"], False, True, False, False, ["a", "a"], ["b"],
    ]
