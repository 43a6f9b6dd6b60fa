import datetime as dt
from decimal import Decimal

import pytest

from ledgerloom.operators import pricing
from ledgerloom.sources.tables import Tables

CALL = (
    "id bigint, endpoint string, model string, input_tokens int, output_tokens int,"
    " cache_read_input_tokens int, cache_creation_input_tokens int, created_at timestamp"
)


@pytest.fixture
def prices(spark):
    return Tables(spark, "unused").prices()


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize(
    "model, when, prefix, start",
    [
        ("m-a-1-20240101", "2024-01-09 23:59:59", "m-a", dt.date(2000, 1, 1)),
        ("m-a-1-20240101", "2024-01-10 00:00:00", "m-a-1", dt.date(2024, 1, 10)),
        ("m-a-1-20240101", "2024-01-16 00:00:00", "m-a-1", dt.date(2024, 1, 10)),
        ("m-a", "2024-01-14 12:00:00", "m-a", dt.date(2000, 1, 1)),
        ("m-a", "2024-01-15 00:00:00", "m-a", dt.date(2024, 1, 15)),
        ("m-b-2", "2024-01-19 23:00:00", None, None),
        ("m-b-2", "2024-01-20 00:00:00", "m-b", dt.date(2024, 1, 20)),
        ("x_a", "2024-01-20 00:00:00", None, None),
        ("x%abc", "2024-01-20 00:00:00", "x%a", dt.date(2000, 1, 1)),
        ("m-a", "1999-12-31 00:00:00", None, None),
    ],
)
def test_price_in_force(spark, prices, model, when, prefix, start):
    calls = spark.createDataFrame([(1, "text", model, 1, 1, 1, 1, at(when))], CALL)
    row = pricing.price_calls(calls, prices).first()
    assert (row.model_prefix, row.valid_from) == (prefix, start)
    pricing.register_price_function(spark, prices)
    found = spark.sql(f"SELECT * FROM model_price_at('{model}', TIMESTAMP '{when}')").collect()
    assert [(r.model_prefix, r.valid_from) for r in found] == ([(prefix, start)] if prefix else [])


def test_usage_counts_unpriced_calls_apart(spark, prices):
    calls = spark.createDataFrame(
        [
            (1, "text", "m-b-2", 1000, 10, 0, 0, at("2024-01-19 10:00:00")),
            (2, "text", "m-b-2", 1000, 10, 0, 0, at("2024-01-20 10:00:00")),
            (3, "ask", "x_a", 7, 7, 7, 7, at("2024-01-20 10:00:00")),
            (4, "ask", "m-a", 7, 7, 7, 7, at("2024-02-01 00:00:00")),
        ],
        CALL,
    )
    lines = pricing.usage_summary(calls, prices, "2024-01-01", "2024-01-31")
    rows = {(r.endpoint, r.model): r for r in lines.collect()}
    assert set(rows) == {("text", "m-b-2"), ("ask", "x_a")}
    line = rows["text", "m-b-2"]
    assert (line.calls, line.input_tokens, line.unpriced_calls) == (2, 2000, 1)
    assert line.cost_usd == Decimal("0.010500")
    assert rows["ask", "x_a"].cost_usd is None
    total = pricing.usage_total(lines).first()
    assert (total.total_cost_usd, total.unpriced_calls) == (Decimal("0.010500"), 2)


def test_empty_ledger_costs_nothing(spark, prices):
    lines = pricing.usage_summary(spark.createDataFrame([], CALL), prices, "2024-01-01", "2024-12-31")
    total = pricing.usage_total(lines).first()
    assert (total.total_cost_usd, total.unpriced_calls) == (0, 0)


def test_join_without_broadcast_gives_the_same_prices(spark, prices, monkeypatch):
    rows = [
        (i, "text", m, i, i, i, i, at(f"2024-01-{d:02d} 08:00:00"))
        for i, (m, d) in enumerate((m, d) for m in ("m-a", "m-a-1-x", "m-b-2", "x_a") for d in range(1, 29))
    ]
    calls = spark.createDataFrame(rows, CALL)
    hinted = pricing.price_calls(calls, prices).collect()
    monkeypatch.setattr(pricing, "MAX_BROADCAST_INTERVALS", 0)
    assert sorted(pricing.price_calls(calls, prices).collect()) == sorted(hinted)
