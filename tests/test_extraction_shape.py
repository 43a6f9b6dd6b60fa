"""The record's shape is told from one text, and every field is read once."""

import contextlib
import io
import json

import pytest

from ledgerloom.operators import extraction
from ledgerloom.sources.tables import Tables
from tests.test_intake import complete, extraction_json


def parsed(spark, raw):
    rows = spark.createDataFrame([("1", raw, "end_turn")], "id string, raw_response string, stop_reason string")
    return extraction.parse(rows).first().extraction


def plan(rows):
    with contextlib.redirect_stdout(out := io.StringIO()):
        rows.explain()
    return out.getvalue()


def test_no_value_is_cast_from_a_variant_and_items_are_a_column_when_collected(spark):
    shown = plan(extraction.complete(Tables(spark, "/root/testdata/sf0.001").responses()))
    assert "variant_get" not in shown and "to_json" not in shown.split("Exchange", 1)[1]
    assert "collect_list(item#" in shown


@pytest.mark.parametrize("value", ["1e999", "-1e999", "12.5", "-0.0", "1e2", "1234567890123456789012345678901234567890", "0.1234567890123456789", "null"])
def test_numbers_are_read_as_they_are(spark, value):
    raw = extraction_json(total_amount=77777).replace("77777", value)
    assert parsed(spark, raw).total_amount == (None if value == "null" else float(value))


@pytest.mark.parametrize("changes", [
    {"total_amount": "Infinity"}, {"confidence_score": "-Infinity"},
    {"line_items": [{"description": "x", "quantity": "Infinity", "category": "Food"}]},
    {"line_items": [{"description": "x", "quantity": "Infinity", "category": "Food"}, {"description": "x", "quantity": 1, "category": "Food"}]},
])
def test_a_text_is_no_infinite_number(spark, changes):
    assert parsed(spark, extraction_json(**changes)) is None
    assert parsed(spark, extraction_json(**changes, merchant="Infinity")) is None


def test_an_infinite_number_beside_a_text_of_that_name(spark):
    raw = extraction_json(merchant="Infinity", total_amount=77777).replace("77777", "1e999")
    assert (parsed(spark, raw).merchant, parsed(spark, raw).total_amount) == ("Infinity", float("inf"))


@pytest.mark.parametrize("text", ['"', "\\", 'a","b":"c', "\n\t \u0085", "\\\"\n" * 200_000, "x" * 500_000, "\U0001F600é", "}", ""])
def test_texts_stay_whole(spark, text):
    found = parsed(spark, extraction_json(merchant=text, location=text))
    assert (found.merchant, found.location) == (text, text)


def test_layout_and_order_of_keys_do_not_matter(spark):
    record = json.loads(extraction_json())
    turned = json.dumps(dict(reversed(record.items())), indent=3)
    assert parsed(spark, turned) == parsed(spark, extraction_json()) is not None


@pytest.mark.parametrize("change", [
    json.dumps, lambda raw: f"[{raw}]", lambda raw: raw[:-1] + ',"merchant":"again"}', lambda raw: raw[:-1],
    lambda raw: "", lambda raw: "null", lambda raw: raw.replace('"merchant"', '"Merchant"'),
])
def test_other_json_has_no_record(spark, change):
    assert complete(spark, change(extraction_json())).failure_reason == extraction.UNREADABLE
