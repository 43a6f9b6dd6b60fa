import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction, lifecycle, uploads
from ledgerloom.operators.categories import (
    bridge_from_lists, bridge_ids, extend_dimension, named_bridge, with_categories,
)
from ledgerloom.plans.intake import take_in
from ledgerloom.schemas import MAX_UPLOAD_BYTES, RECEIPTS
from ledgerloom.sources import readers, sinks

PDF = b"%PDF-1.4 own filler"
JPEG = b"\xff\xd8\xff" + b"own filler"
PNG = b"\x89PNG\r\n\x1a\n" + b"own filler"
GIF = b"GIF89a own filler"
WEBP = b"RIFF\x24\x00\x00\x00WEBPVP8 "
WAV = b"RIFF\x24\x00\x00\x00WAVEfmt "
FILE = (
    "id string, filename string, kind string, declared_type string, declared_size bigint,"
    " content binary, created_at timestamp"
)


def check(spark, kind, declared, content, size=None):
    size = len(content or b"") if size is None else size
    row = ("1", "receipt", kind, declared, size, content, dt.datetime(2026, 1, 1))
    return uploads.check_uploads(spark.createDataFrame([row], FILE)).first()


@pytest.mark.parametrize(
    "content, expected",
    [(JPEG, "image/jpeg"), (PNG, "image/png"), (GIF, "image/gif"), (b"GIF87a", "image/gif"),
     (WEBP, "image/webp")],
)
def test_media_type_is_read_from_the_bytes(spark, content, expected):
    row = check(spark, "image", "image/jpeg", content)
    assert (row.reject_reason, row.media_type) == (None, expected)


@pytest.mark.parametrize(
    "kind, declared, content, size, words",
    [
        ("pdf", "application/pdf", None, None, 'field name "file"'),
        ("pdf", "application/pdf", PDF, MAX_UPLOAD_BYTES + 1, "The PDF is larger than the 10 MB"),
        ("image", "image/png", b"", None, "The uploaded image is empty."),
        ("pdf", "image/jpeg", PDF, None, 'Only application/pdf is accepted, but the upload declared "image/jpeg".'),
        ("image", "application/pdf", JPEG, None, "image/webp are accepted"),
        ("pdf", "application/pdf", JPEG, None, "does not start with the PDF signature"),
        ("image", "image/png", PDF, None, "contents match none of those formats"),
        ("image", "image/png", WAV, None, "contents match none of those formats"),
    ],
)
def test_rejections(spark, kind, declared, content, size, words):
    row = check(spark, kind, declared, content, size)
    assert words in row.reject_reason and row.media_type is None


def test_exact_limit_and_pdf_pass(spark):
    assert check(spark, "pdf", "application/pdf", PDF, MAX_UPLOAD_BYTES).reject_reason is None


def test_text_intake(spark):
    rows = [(i, t, dt.datetime(2026, 1, 1)) for i, t in
            enumerate(["ok", "", None, "x" * 10_000, "x" * 10_001, "\U0001F600" * 5_001])]
    texts = spark.createDataFrame(rows, "id int, text string, created_at timestamp")
    assert [r.id for r in uploads.pending_texts(texts, F.lit("p")).orderBy("id").collect()] == [0, 3, 5]
    refused = uploads.rejected(uploads.check_texts(texts)).orderBy("id").collect()
    assert [(r.id, r.reject_reason) for r in refused] == [
        (1, "The text is empty."), (2, "The text is empty."), (4, "The text is longer than 10000 characters."),
    ]


def extraction_json(**changes):
    record = {
        "merchant": "Fresh Grocer", "merchant_details": "Fresh Grocer Lda",
        "merchant_vatNumber": "PT501234567", "merchant_phone": None, "invoice_number": "FT 1",
        "location": "Downtown", "date": "2026-08-12", "total_amount": 4.5, "currency": "EUR",
        "payment_method": "Card",
        "line_items": [{"description": "Bananas", "quantity": 1, "category": "Food"}],
        "category_evidence": "groceries", "categories": ["Other"], "confidence_score": 0.95,
        "anomaly_evidence": "none", "is_suspicious": False, "flag_reason": None,
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v != "DROP"})


def complete(spark, raw, stop="end_turn"):
    rows = spark.createDataFrame([("1", raw, stop)], "id string, raw_response string, stop_reason string")
    return extraction.complete(rows).first()


def test_completed_row(spark):
    row = complete(spark, extraction_json(date="2026-08-15", total_amount=4.505))
    assert (row.status, row.failure_reason) == ("completed", None)
    assert (row.total_amount, row.currency) == (Decimal("4.51"), "EUR")
    assert (row.confidence_score, row.receipt_date) == (Decimal("0.95"), dt.date(2026, 8, 15))
    assert row.categories == ["Food", "Other"]
    assert (row.is_suspicious, row.flag_reason) == (True, "Issued on a Saturday.")
    assert json.loads(row.raw_response)["merchant"] == "Fresh Grocer"


@pytest.mark.parametrize(
    "raw, stop, reason",
    [
        (extraction_json(), "max_tokens", extraction.NO_ROOM),
        (None, "refusal", extraction.DECLINED),
        (None, "end_turn", extraction.UNREADABLE),
        ("{broken", "end_turn", extraction.UNREADABLE),
        (extraction_json(location="DROP"), "end_turn", extraction.UNREADABLE),
        (extraction_json(extra=1), "end_turn", extraction.UNREADABLE),
        (extraction_json(is_suspicious="yes"), "end_turn", extraction.UNREADABLE),
        (extraction_json(is_suspicious=None), "end_turn", extraction.UNREADABLE),
        (extraction_json(categories=["Dinners"]), "end_turn", extraction.UNREADABLE),
        (extraction_json(line_items=[{"description": "x", "quantity": None, "category": "Pets"}]),
         "end_turn", extraction.UNREADABLE),
        (extraction_json(total_amount=99999999999), "end_turn", extraction.DOES_NOT_FIT),
        (extraction_json(currency="EURO"), "end_turn", extraction.DOES_NOT_FIT),
        (extraction_json(confidence_score=10.5), "end_turn", extraction.DOES_NOT_FIT),
        (extraction_json(date="2026-02-30"), "end_turn", extraction.DOES_NOT_FIT),
    ],
)
def test_failed_rows_keep_nothing(spark, raw, stop, reason):
    row = complete(spark, raw, stop)
    assert (row.status, row.failure_reason) == ("failed", reason)
    assert (row.merchant, row.total_amount, row.categories, row.flag_reason) == (None,) * 4


def test_status_and_ledger(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    events = spark.createDataFrame(
        [("a", "pending", at(1)), ("a", "completed", at(2)), ("b", "pending", at(1)),
         ("c", "failed", at(1)), ("c", "pending", at(1))],
        "id string, status string, updated_at timestamp",
    )
    assert {r.id: r.status for r in lifecycle.latest_status(events).collect()} == {
        "a": "completed", "b": "pending", "c": "failed",
    }
    asked = spark.createDataFrame(
        [(1, None, "ask", at(1), ["m", "m"], [1, 2], [3, 4], [0, 0], [0, 0]),
         (2, "r", "text", at(1), [], [], [], [], [])],
        "no int, receipt_id string, endpoint string, created_at timestamp, model array<string>,"
        " input_tokens array<int>, output_tokens array<int>, cache_read_input_tokens array<int>,"
        " cache_creation_input_tokens array<int>",
    )
    rows = lifecycle.ledger_rows(lifecycle.with_request_ids(asked, "no")).collect()
    assert [(r.model, r.input_tokens, r.output_tokens) for r in rows] == [("m", 1, 3), ("m", 2, 4)]
    assert len({r.request_id for r in rows}) == 1


def test_backfill_and_deletes(spark):
    old = spark.createDataFrame([("1", "shop", None), ("2", "x", "failed")], "id string, merchant string, status string")
    rows = lifecycle.to_schema(old, RECEIPTS)
    assert rows.columns == RECEIPTS.names
    first = rows.orderBy("id").first()
    assert (first.source_type, first.is_suspicious, first.status, first.fx_rate) == ("text", False, "pending", None)

    receipts = spark.createDataFrame(
        [("1", None), ("2", "1"), ("3", "2"), ("4", None)], "id string, duplicate_of string"
    )
    bridge = spark.createDataFrame([("1", "Food"), ("2", "Food")], "receipt_id string, category string")
    calls = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "id int, receipt_id string")
    left = lifecycle.delete_receipts(receipts, bridge, calls, spark.createDataFrame([("1",)], "id string"))
    assert sorted(left["receipts"].collect()) == sorted(
        spark.createDataFrame([("2", None), ("3", "2"), ("4", None)], "id string, duplicate_of string").collect()
    )
    assert [r.receipt_id for r in left["bridge"].collect()] == ["2"]
    assert {r.id: r.receipt_id for r in left["calls"].collect()} == {1: None, 2: "2", 3: None}


def test_category_dimension_has_no_gaps(spark):
    lists = [("1", [" Food ", "Food", " "]), ("2", ["Health", "Leisure"]), ("3", [])]
    receipts = spark.createDataFrame(lists, "id string, categories array<string>")
    bridge = bridge_from_lists(receipts)
    stored = spark.createDataFrame([(4, "Food")], "id int, name string")
    dimension = extend_dimension(stored, bridge)
    assert {r.name for r in dimension.collect()} == {"Food", "Health", "Leisure"}
    assert sorted(r.id for r in dimension.collect()) == [4, 5, 6]
    names = named_bridge(bridge_ids(bridge, dimension), dimension)
    full = with_categories(receipts.drop("categories"), names)
    assert {r.id: r.categories for r in full.collect()} == {"1": ["Food"], "2": ["Health", "Leisure"], "3": []}
    many = spark.range(300).select(F.lit("x").alias("receipt_id"), F.concat(F.lit("n"), "id").alias("category"))
    ids = sorted(r.id for r in extend_dimension(stored, many).collect())
    assert ids == list(range(4, 305))


def test_files_and_cases_are_read(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.PDF").write_bytes(PDF)
    (tmp_path / "files" / "b.jpg").write_bytes(PNG)
    (tmp_path / "files" / "c.txt").write_bytes(b"hello")
    checked = uploads.check_uploads(readers.read_files(spark, str(tmp_path / "files")))
    rows = {r.filename: r for r in checked.collect()}
    assert rows["a.PDF"].media_type == "application/pdf"
    assert rows["b.jpg"].media_type == "image/png"
    assert "accepted" in rows["c.txt"].reject_reason
    pending = {r.source_filename: r for r in uploads.pending_uploads(checked, F.lit("p")).collect()}
    assert pending["a.PDF"].source_bytes == len(PDF) and pending["a.PDF"].raw_text is None

    (tmp_path / "cases.json").write_text(json.dumps({"description": "x", "cases": [
        {"id": "a", "raw_text": "t", "expected_categories": ["Food"], "expected_suspicious": True},
        {"id": "b", "image": "b.jpg", "same_as": "a", "expected_categories": ["Food"]},
        {"id": "c", "expected_categories": []},
    ]}))
    cases = readers.read_cases(spark, str(tmp_path / "cases.json"))
    got = spark.createDataFrame(
        [("a", ["Food"], True, None)], "id string, got array<string>, suspicious boolean, error string"
    )
    results = {r.id: r for r in readers.results_from_cases(cases, got).collect()}
    assert [results[i].source for i in "abc"] == ["text", "image", "text"]
    assert results["c"].skipped and not results["a"].skipped
    assert results["b"].same_as == "a" and results["b"].got == []


def test_batches_see_only_earlier_ones_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path / "store")
    rates = spark.createDataFrame([("USD", dt.date(2026, 8, 1), Decimal("0.5"))],
                                  "currency string, rate_date date, rate decimal(18,8)")

    def responses(*rows):
        return spark.createDataFrame(
            [(i, raw, "end_turn", dt.datetime(2026, 8, 20, h)) for i, h, raw in rows], readers.RESPONSE
        )

    take_in(responses(("a", 5, extraction_json()), ("b", 1, extraction_json(currency="USD")),
                      ("bad", 1, "{")), rates, root, 0)
    second = responses(("c", 1, extraction_json(merchant=" fresh grocer")),
                       ("d", 9, extraction_json(date=None)),
                       ("e", 3, extraction_json(total_amount=7)),
                       ("f", 4, extraction_json(total_amount=7)))
    for _ in range(2):
        take_in(second, rates, root, 1)
    rows = {r.id: r for r in spark.read.parquet(f"{root}/receipts").collect()}
    assert len(rows) == 7 and spark.read.parquet(f"{root}/receipts").count() == 7
    assert {i: rows[i].duplicate_of for i in "abcdef"} == {
        "a": None, "b": None, "c": "a", "d": None, "e": None, "f": "e",
    }
    assert rows["bad"].status == "failed" and rows["bad"].receipt_month == sinks.NO_MONTH
    assert (rows["b"].total_eur, rows["a"].total_eur) == (Decimal("2.25"), Decimal("4.50"))
    assert spark.read.parquet(f"{root}/bridge").count() == 12


@pytest.mark.parametrize(
    "changes",
    [
        {"merchant": 42}, {"merchant": {"a": 1}}, {"merchant": ["a"]}, {"total_amount": "4.5"}, {"total_amount": True},
        {"confidence_score": None}, {"is_suspicious": None}, {"is_suspicious": 0}, {"categories": "Food"},
        {"categories": [1]}, {"categories": [None]}, {"line_items": None}, {"line_items": [1]}, {"line_items": [None]},
        {"line_items": [{"description": "x", "category": "Food"}]},
        {"line_items": [{"description": "x", "quantity": 1, "category": "Food"}, {"description": "x", "category": "Food"}]},
        {"line_items": [{"description": 5, "quantity": 1, "category": "Food"}]},
        {"line_items": [{"description": "x", "quantity": "1", "category": "Food"}]},
        {"line_items": [{"description": "x", "quantity": 1, "category": "Food", "price": 2}]},
        {"extra": 1},
    ],
)
def test_types_and_keys_are_strict(spark, changes):
    rows = spark.createDataFrame([("1", extraction_json(**changes), "end_turn")], "id string, raw_response string, stop_reason string")
    assert extraction.parse(rows).first().extraction is None


@pytest.mark.parametrize(
    ("date", "stored"),
    [
        ("2026-08-15", dt.date(2026, 8, 15)), ("2026-08-15T10:00", dt.date(2026, 8, 15)),
        ("2026-08-15 10:00:00", dt.date(2026, 8, 15)), (None, None),
        ("2026-08", "failed"), ("2026", "failed"), ("2026-02-30", "failed"), ("soon", "failed"), ("2026-08-155", "failed"),
    ],
)
def test_only_full_days_are_stored(spark, date, stored):
    rows = spark.createDataFrame([("1", extraction_json(date=date), "end_turn")], "id string, raw_response string, stop_reason string")
    row = extraction.complete(rows).first()
    assert (row.status if row.status == "failed" else row.receipt_date) == stored


@pytest.mark.parametrize("items, usable", [
    ([], True),
    ([{"description": "x", "quantity": None, "category": "Food"}, {"description": "y", "quantity": 2.5, "category": "Food"}], True),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": "y", "category": "Food"}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"quantity": 1, "category": "Food"}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": None, "quantity": 1, "category": "Food"}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": "y", "quantity": 1, "category": None}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": 5, "quantity": 1, "category": "Food"}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": "y", "quantity": "1", "category": "Food"}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, {"description": "y", "quantity": 1, "category": "Food", "price": 1}], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, None], False),
    ([{"description": "x", "quantity": 1, "category": "Food"}, "milk"], False),
    ([None], False),
    (["milk"], False),
    ([{}], False),
])
def test_every_item_has_its_keys_and_types(spark, items, usable):
    row = complete(spark, extraction_json(line_items=items))
    assert row.status == ("completed" if usable else "failed")
