"""Whole intake of a batch of responses: parse, judge, convert, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import month_key
from ..operators.anomalies import united
from ..operators.categories import bridge_from_lists, by_category, first_ids, reserved_ids
from ..operators.duplicates import KEY, first_copies, keyed, match_firsts
from ..operators.extraction import complete
from ..operators.fx import published, with_eur
from ..operators.joining import fits, small_broadcast
from ..operators.lifecycle import ledger_rows, with_request_ids
from ..operators.percentiles import percentile_points
from ..operators.spreads import above_floor, compare, spread_counts
from ..schemas import COMPLETED, OUTLIER_QUANTILE, RECEIPTS, TEXT, TOKEN_PRICES
from ..sources.sinks import NO_MONTH, write_calls, write_receipts, write_table, written

MAX_BROADCAST_KEYS = 1_000_000
HISTORY = ["id", "merchant", "receipt_date", "total_amount", "currency", "status", "created_at"]
HISTORY_SCHEMA = (
    "id string, merchant string, receipt_date date, total_amount decimal(12,2), currency string,"
    " status string, created_at timestamp, receipt_month string, batch string"
)
CATEGORY_SCHEMA = "id bigint, name string, batch string"
SOURCE_COLUMNS = ["raw_text", "prompt_used", "source_type", "source_filename", "source_bytes"]
COUNTS_SCHEMA = "category string, cents bigint, n bigint, batch string"


def stored(spark: SparkSession, root: str, table: str, schema: str, before: int) -> DataFrame:
    """Rows of earlier batches; an output folder that does not exist yet is empty."""
    rows = spark.read.schema(schema).option("ignoreMissingFiles", "true")
    try:
        found = rows.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    except Exception as error:  # noqa: BLE001 - only a missing folder is expected here
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return found.filter(F.col("batch").cast("bigint") < before)


def possible_copies(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Earlier receipts that share a key with the new rows.

    The month of the date is a folder of the stored receipts, so only the months of the
    new rows are read. A small set of new keys is broadcast; with a larger one the months
    are taken whole (their list is bounded by the calendar) and the aggregation to the
    earliest row per key, which combines before its shuffle, does the reduction.
    """
    if history.isEmpty():
        return history.select(*HISTORY)
    month = F.coalesce(month_key(F.col("receipt_date")), F.lit(NO_MONTH))
    keys = keyed(rows.withColumn("receipt_month", month)).select("receipt_month", *KEY).distinct()
    if fits(keys, MAX_BROADCAST_KEYS):
        same = ["receipt_month", *KEY]
        return keyed(history).join(F.broadcast(keys), same, "left_semi").select(*HISTORY)
    months = F.broadcast(keys.select("receipt_month").distinct())
    return history.join(months, "receipt_month", "left_semi").select(*HISTORY)


def judge(
    done: DataFrame, history: DataFrame, counts: DataFrame, bridge: DataFrame, root: str, batch: int
) -> DataFrame:
    """Verdicts of new completed receipts against what was stored before them.

    Stored receipts come first; two copies inside one batch are linked by
    (created_at, id). Outliers are measured against the stored value counts only. What the
    verdicts need of other receipts is found over a few columns and stored under the batch, so that
    the whole receipts only meet what fired, without a shuffle where that is little.
    """
    spark = done.sparkSession
    slim = done.select(*HISTORY).withColumn("in_batch", F.lit(1))
    earlier = possible_copies(history, slim).withColumn("in_batch", F.lit(0))
    firsts = first_copies(
        earlier.unionByName(slim), F.col("in_batch") == 1, order=("in_batch", "created_at", "id")
    )
    totals = counts.groupBy("category", "cents").agg(F.sum("n").alias("n"))
    spreads = written(percentile_points(totals, ["category"], OUTLIER_QUANTILE))
    tested = above_floor(done.filter(F.col("total_amount") > 0), spreads).select(
        "id", "total_amount", "currency", "status"
    )
    far_above = compare(by_category(small_broadcast(tested, MAX_BROADCAST_KEYS), bridge), spreads)
    found = {}
    for table, rows in (("first_copies", firsts), ("outliers", far_above)):
        write_table(rows, root, table, batch)
        own = spark.read.schema(rows.schema).parquet(f"{root}/{table}/batch={batch}")
        found[table] = small_broadcast(own, MAX_BROADCAST_KEYS)
    return united(match_firsts(done, found["first_copies"]), found["outliers"])


def with_source(rows: DataFrame, pending: DataFrame | None) -> DataFrame:
    """Responses with what is known of their input: text, prompt, source, and when it came in.

    ``pending`` are the rows of ``uploads``; a response without one came as text at the time of the response.
    ``updated_at`` is the time of the response.
    """
    answered = rows.withColumnRenamed("created_at", "updated_at")
    kinds = {f.name: f.dataType for f in RECEIPTS.fields}
    if pending is None:
        given = {c: F.lit(None).cast(kinds[c]) for c in SOURCE_COLUMNS}
        joined = answered.withColumns({**given, "created_at": F.col("updated_at")})
    else:
        names = [*SOURCE_COLUMNS, "created_at"]
        columns = [F.col(c).cast(kinds[c]).alias(c) if c in pending.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
        inputs = pending.select(F.col("id").cast("string").alias("id"), *columns)
        joined = answered.join(inputs, "id", "left").withColumn("created_at", F.coalesce("created_at", "updated_at"))
    return joined.withColumn("source_type", F.coalesce("source_type", F.lit(TEXT)))


def calls_made(responses: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger rows of every response, answered or failed: a refused or broken one has cost tokens as well.

    ``calls`` of a response is an array of (model, token counters).
    """
    fields = ["model", *TOKEN_PRICES]
    kind = rows.select("id", F.col("source_type").alias("endpoint"))
    made = responses.select("id", F.col("id").alias("receipt_id"), "created_at", *[F.col(f"calls.{c}").alias(c) for c in fields])
    return ledger_rows(with_request_ids(made.join(kind, "id"), "receipt_id", "created_at"))


def with_category_ids(bridge: DataFrame, root: str, batch: int) -> DataFrame:
    """The bridge with ids; names that no earlier batch has are stored under the batch."""
    spark = bridge.sparkSession
    known = first_ids(stored(spark, root, "categories", CATEGORY_SCHEMA, batch))
    write_table(reserved_ids(known, bridge, batch), root, "categories", batch)
    own = spark.read.schema("id bigint, name string").parquet(f"{root}/categories/batch={batch}")
    ids = known.unionByName(own).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return bridge.join(ids, "category").select("receipt_id", "category", "category_id")


def take_in(responses: DataFrame, rates: DataFrame, root: str, batch: int, pending: DataFrame | None = None) -> None:
    """Store one batch of responses under ``root``: receipts, bridge, categories, value counts and, where responses
    carry ``calls``, the ledger.

    Reads only batches before this one and overwrites its own, so running it again gives
    the same result. The parsed receipts are written before they are judged, which cuts
    their lineage with files every executor can read again.
    """
    spark = responses.sparkSession
    responses = responses.withColumn("id", F.col("id").cast("string"))
    # Joined to their input as they came: the raw text alone is less to shuffle than with all that is read from it.
    answered = with_source(responses.select("id", "raw_response", "stop_reason", "created_at"), pending)
    parsed = complete(answered, "updated_at", *SOURCE_COLUMNS, "created_at")
    write_table(parsed, root, "parsed", batch, compression="zstd")
    rows = spark.read.schema(parsed.schema).parquet(f"{root}/parsed/batch={batch}")
    if "calls" in responses.columns:
        # First of all, so that a failure further on does not lose what the calls have cost.
        write_calls(calls_made(responses, rows), root, batch)
    done = rows.filter(F.col("status") == COMPLETED)
    write_table(with_category_ids(bridge_from_lists(done), root, batch), root, "bridge", batch)
    bridge = spark.read.schema("receipt_id string, category string").parquet(f"{root}/bridge/batch={batch}")
    history = stored(spark, root, "receipts", HISTORY_SCHEMA, batch)
    counts = stored(spark, root, "value_counts", COUNTS_SCHEMA, batch)
    judged = judge(done, history, counts, bridge, root, batch).drop("categories")
    # The batch's own day stands for today, so that a later rerun gives the same rates. The rates are stored once, which
    # tells the planner how few they are.
    converted = with_eur(judged, written(published(rates)), F.to_date("updated_at"))
    failed = rows.filter(F.col("status") != COMPLETED)
    write_receipts(
        converted.unionByName(failed.drop("categories"), allowMissingColumns=True), root, batch
    )
    write_table(spread_counts(done, bridge), root, "value_counts", batch)
