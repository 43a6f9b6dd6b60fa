import datetime as dt
import json
from decimal import Decimal

from ledgerloom.operators import pricing
from ledgerloom.schemas import CALLS
from ledgerloom.sources import readers
from ledgerloom.sources.tables import Tables
from ledgerloom.streaming.intake import start_intake
from ledgerloom.streaming.usage import current_usage, start_daily_usage
from tests.test_intake import extraction_json


def test_intake_stream_links_copies_across_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def drop(name, *rows):
        lines = [
            json.dumps({"id": i, "raw_response": raw, "stop_reason": "end_turn",
                        "created_at": f"2026-08-20T0{h}:00:00Z"})
            for i, h, raw in rows
        ]
        (source / name).write_text("\n".join(lines))

    rates = spark.createDataFrame([("USD", dt.date(2026, 8, 1), Decimal("0.5"))],
                                  "currency string, rate_date date, rate decimal(18,8)")
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        stream = readers.stream_responses(spark, str(source), maxFilesPerTrigger=1)
        start_intake(stream, rates, root, checkpoint).awaitTermination()

    drop("1.json", ("a", 1, extraction_json()), ("b", 2, extraction_json(total_amount=9)))
    run()
    drop("2.json", ("c", 3, extraction_json()), ("d", 4, extraction_json(total_amount=1)))
    run()
    rows = {r.id: r.duplicate_of for r in spark.read.parquet(f"{root}/receipts").collect()}
    assert rows == {"a": None, "b": None, "c": "a", "d": None}


def call(id, when, model="m-a", tokens=1000):
    return (id, None, "text", model, tokens, 10, 0, 0, dt.datetime.fromisoformat(when), None)


def write(spark, folder, rows):
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(folder)


def usage_rows(rows):
    return sorted((str(r.day), r.model, r.calls, r.input_tokens, r.cost_usd) for r in rows.collect())


def test_daily_usage_stream(spark, tmp_path):
    prices = Tables(spark, "unused").prices()
    source, root, checkpoint = (str(tmp_path / n) for n in ("calls", "store", "checkpoint"))
    first = [call(1, "2024-01-10 08:00:00"), call(2, "2024-01-10 09:00:00", "x_a"),
             call(3, "2024-01-13 08:00:00")]
    second = [call(4, "2024-01-10 10:00:00"), call(5, "2024-01-13 09:00:00"),
              call(6, "2024-01-20 09:00:00")]

    def run():
        stream = readers.stream_calls(spark, source, maxFilesPerTrigger=1)
        start_daily_usage(stream, prices, root, checkpoint, "1 day").awaitTermination()

    write(spark, source, first)
    run()
    write(spark, source, second)
    run()
    written = spark.read.parquet(f"{root}/usage")
    # Call 4 is three days late and is dropped; 20 January is not finished yet.
    kept = [c for c in first + second if c[0] not in (4, 6)]
    batch = pricing.priced_days(pricing.daily_usage(spark.createDataFrame(kept, CALLS)), prices)
    expected = batch.select("day", "model", "calls", "input_tokens",
                            pricing.per_million(pricing.cost()).alias("cost_usd"))
    assert usage_rows(written) == usage_rows(expected)
    assert written.agg({"unpriced_calls": "sum"}).first()[0] == 1


def test_update_mode_keeps_the_newest_version(spark, tmp_path):
    prices = Tables(spark, "unused").prices()
    source, root, checkpoint = (str(tmp_path / n) for n in ("calls", "store", "checkpoint"))
    for rows in ([call(1, "2024-01-10 08:00:00")], [call(2, "2024-01-10 09:00:00")]):
        write(spark, source, rows)
        stream = readers.stream_calls(spark, source, maxFilesPerTrigger=1)
        start_daily_usage(stream, prices, root, checkpoint, mode="update").awaitTermination()
    rows = current_usage(spark.read.parquet(f"{root}/usage")).collect()
    assert [(r.calls, r.input_tokens) for r in rows] == [(2, 2000)]
