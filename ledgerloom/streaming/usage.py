"""Daily priced usage of a ledger that is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import per_million
from ..operators.pricing import cost, priced_days
from ..schemas import TOKEN_PRICES
from ..sources.sinks import write_table, written


def windowed_usage(calls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls and tokens per UTC day, endpoint and model, with a bound on late rows."""
    return (
        calls.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("day"), "endpoint", "model")
        .agg(
            F.count("*").alias("calls"),
            *[F.sum(F.col(c).cast("bigint")).alias(c) for c in TOKEN_PRICES],
        )
    )


def priced(windowed: DataFrame, prices: DataFrame) -> DataFrame:
    """Finished days with their cost; only day sums are joined to the price list."""
    days = windowed.withColumn("day", F.to_date("day.start"))
    return priced_days(days, prices).select(
        "day",
        "endpoint",
        "model",
        "calls",
        *TOKEN_PRICES,
        per_million(cost()).alias("cost_usd"),
        F.when(F.col("model_prefix").isNull(), F.col("calls"))
        .otherwise(F.lit(0))
        .alias("unpriced_calls"),
    )


def start_daily_usage(
    calls: DataFrame,
    prices: DataFrame,
    root: str,
    checkpoint: str,
    lateness: str = "1 day",
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write priced days under ``root``/usage.

    In ``append`` mode a day is written once, when the watermark has passed it; rows that
    come later than ``lateness`` allows are dropped. In ``update`` mode each micro-batch
    writes the days it changed, and the row of the largest batch is the current one.
    """
    def store(rows: DataFrame, batch: int) -> None:
        # The day sums are stored first, so that the stateful aggregation runs once a batch.
        write_table(priced(written(rows), prices), root, "usage", batch)

    writer = (
        windowed_usage(calls, lateness)
        .writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_usage(rows: DataFrame) -> DataFrame:
    """The latest version of each day from update-mode output (with its ``batch``)."""
    fields = [c for c in rows.columns if c not in ("day", "endpoint", "model", "batch")]
    newest = F.max_by(F.struct(*fields), F.col("batch").cast("bigint")).alias("row")
    return rows.groupBy("day", "endpoint", "model").agg(newest).select(
        "day", "endpoint", "model", "row.*"
    )
