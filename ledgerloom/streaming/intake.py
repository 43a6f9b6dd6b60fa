"""Intake of responses as they arrive, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.intake import take_in


def start_intake(
    responses: DataFrame, rates: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Judge and store every arriving response under ``root``.

    A micro-batch writes folders named by its batch id and reads only earlier ones, so
    a batch that is repeated after a failure replaces its own output.
    """
    writer = responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: take_in(rows, rates, root, batch)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
