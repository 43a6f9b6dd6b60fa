"""Append-only outputs.

Each writer takes a ``batch`` label and overwrites only that label's folder, so a job
that is run again after a failure leaves one copy of its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import month_key
from ..session import shared_dir

NO_MONTH = "undated"


def _folder(root: str, table: str, batch: str | int) -> str:
    return f"{root.rstrip('/')}/{table}/batch={batch}"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one run, where every executor can reach it."""
    return f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read back.

    Later steps start from files that outlive any executor, and their real size is known
    to the planner.
    """
    path = new_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_receipts(receipts: DataFrame, root: str, batch: str | int) -> None:
    """Receipts by month of their date, so that date ranges prune whole folders."""
    month = F.coalesce(month_key(F.col("receipt_date")), F.lit(NO_MONTH))
    rows = receipts.withColumn("receipt_month", month)
    # Few files per month, and a hot month still written by many tasks.
    rows.hint("rebalance", F.col("receipt_month")).write.mode("overwrite").partitionBy("receipt_month").parquet(
        _folder(root, "receipts", batch)
    )


def write_calls(calls: DataFrame, root: str, batch: str | int) -> None:
    """Ledger rows by day of the call."""
    rows = calls.withColumn("call_day", F.to_date("created_at"))
    rows.hint("rebalance", F.col("call_day")).write.mode("overwrite").partitionBy("call_day").parquet(_folder(root, "calls", batch))


def write_table(rows: DataFrame, root: str, table: str, batch: str | int, **options: str) -> None:
    rows.write.options(**options).mode("overwrite").parquet(_folder(root, table, batch))


def write_scores(scores: dict[str, DataFrame], results: DataFrame, path: str) -> None:
    """A stored evaluation: each score table and every result, as JSON lines."""
    for name, rows in scores.items():
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/scores/{name}")
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/results")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files whose names sort in reading order."""
    ordered = lines.orderBy("section", "key", "line_no").select(F.col("line").alias("value"))
    ordered.write.mode("overwrite").text(path)
