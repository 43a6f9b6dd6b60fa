"""Every registered query: a callable of (spark, folder) that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.files import image_type, is_pdf
from ..operators import (
    anomalies,
    categories,
    duplicates,
    extraction,
    filters,
    fx,
    lifecycle,
    pricing,
    replay,
    scoring,
    spreads,
    totals,
    uploads,
)
from ..operators.categories import with_categories
from ..plans import insights, intake, requests
from ..plans.score_report import numbered, score_report as score_lines
from ..schemas import EXTRACTION, RECEIPTS
from ..sources.sinks import new_folder, write_scores, written
from ..sources.tables import Tables
from ..streaming import state
from ..streaming.usage import current_usage, start_daily_usage
from .checks_sql import CALL_FIRST, CALL_LAST, EVER, FIRST, LAST

TODAY = "2001-12-31"


def number(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def converted(t: Tables) -> DataFrame:
    return fx.with_eur(t.receipts(), t.fx_rates(), F.lit(TODAY).cast("date"))


# totals -----------------------------------------------------------------------


def month_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = totals.month_totals(Tables(spark, folder).receipts(), FIRST, LAST)
    return rows.select("month", "currency", "receipts", number("total"))


def category_totals(spark, folder):
    t = Tables(spark, folder)
    rows = totals.category_totals(t.receipts(), t.receipt_categories(), FIRST, LAST)
    return rows.select("category", "currency", "receipts", number("total"))


def month_totals_eur(spark, folder):
    rows = totals.month_totals_eur(converted(Tables(spark, folder)), FIRST, LAST)
    return rows.select("month", "receipts", number("total_eur"), "unconverted")


def query_totals(spark, folder):
    t = Tables(spark, folder)
    rows = totals.currency_totals(converted(t), t.receipt_categories(), FIRST, LAST)
    return rows.select("currency", "receipts", number("total"), number("total_eur"), "unconverted")


def query_totals_filtered(spark, folder):
    t = Tables(spark, folder)
    rows = totals.currency_totals(
        converted(t),
        t.receipt_categories(),
        FIRST,
        LAST,
        categories=["Food", "Health"],
        merchant="Customer#00000",
        min_total="1000.50",
        max_total="400000",
    )
    return rows.select("currency", "receipts", number("total"), number("total_eur"), "unconverted")


def receipts_with_categories(spark, folder):
    t = Tables(spark, folder)
    rows = with_categories(t.receipts().select("id"), t.receipt_categories())
    return rows.select(
        "id", joined("categories"), F.size("categories").cast("bigint").alias("n")
    )


def spending_summary(spark, folder):
    t = Tables(spark, folder)
    return insights.summary_rows(
        insights.spending_summary(converted(t), t.receipt_categories(), FIRST, LAST)
    )


def insights_result(spark, folder):
    """All that is told about a long period, one without receipts and a reversed one."""
    t = Tables(spark, folder)
    receipts = written(converted(t))
    parts = [
        insights.period_insights(receipts, t.receipt_categories(), t.calls(), t.prices(), first, last).withColumn("period", F.lit(name))
        for name, first, last in (("whole", *EVER), ("empty", "2150-01-01", "2150-12-31"), ("reversed", "2150-12-31", "2150-01-01"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fx_asof(spark, folder):
    t = Tables(spark, folder)
    rows = fx.with_rate(t.receipts(), t.fx_rates(), F.lit(TODAY).cast("date"))
    return rows.select("id", number("fx_rate"), "fx_date")


def fx_asof_in_order(spark, folder):
    """Rates by sorting receipts and rates together, a hot currency in four parts."""
    t = Tables(spark, folder)
    rows = fx.with_rate_in_order(t.receipts(), t.fx_rates(), F.lit(TODAY).cast("date"), salts=4)
    return rows.select("id", number("fx_rate"), "fx_date")


def eur_conversion(spark, folder):
    return converted(Tables(spark, folder)).select(
        "id", "currency", number("total_amount"), number("total_eur")
    )


def response_view(spark, folder):
    t = Tables(spark, folder)
    unset = [
        "merchant_details", "merchant_vatnumber", "merchant_phone", "invoice_number",
        "location", "payment_method", "confidence_score", "duplicate_of",
    ]
    full = with_categories(converted(t), t.receipt_categories()).withColumns(
        {name: F.lit(None).cast("string") for name in unset}
    )
    return filters.response_view(full).select(
        "id", "merchant", "date", "total_amount", "currency", "total_eur", "fx_rate", "fx_date",
        "status", joined("categories"),
    )


def receipt_lookup(spark, folder):
    """A list of ids looked up at once: every labelled document names a receipt here."""
    t = Tables(spark, folder)
    wanted = t.table("labels").select(F.col("doc_id").alias("id"))
    found = with_categories(filters.by_ids(t.receipts(), wanted), t.receipt_categories())
    return found.select("id", "merchant", number("total_amount"), "status", joined("categories"))


# usage ------------------------------------------------------------------------


def price_asof(spark, folder):
    t = Tables(spark, folder)
    rows = pricing.price_calls(t.calls(), t.prices())
    return rows.select(
        "id", "model", "model_prefix", "valid_from", *[number(c) for c in pricing.PRICE_COLUMNS]
    )


def price_asof_in_order(spark, folder):
    t = Tables(spark, folder)
    rows = pricing.price_calls_in_order(t.calls(), t.prices())
    return rows.select(
        "id", "model", "model_prefix", "valid_from", *[number(c) for c in pricing.PRICE_COLUMNS]
    )


def usage_lines(spark, folder):
    t = Tables(spark, folder)
    return pricing.usage_summary(t.calls(), t.prices(), CALL_FIRST, CALL_LAST)


def usage_summary(spark, folder):
    rows = usage_lines(spark, folder)
    return rows.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def usage_total(spark, folder):
    return pricing.usage_total(usage_lines(spark, folder)).select(
        number("total_cost_usd"), "unpriced_calls"
    )


def price_function(spark, folder):
    t = Tables(spark, folder)
    pricing.register_price_function(spark, t.prices())
    days = pricing.daily_usage(t.calls()).groupBy("model", "day").agg(
        F.sum("calls").alias("calls")
    )
    return spark.sql(
        """
        SELECT d.model, d.day, p.model_prefix, CAST(p.input AS double) AS input, d.calls
        FROM {days} d
        LEFT JOIN LATERAL model_price_at(d.model, CAST(d.day AS timestamp)) p ON true
        """,
        days=days,
    )


def usage_stream(spark, folder):
    t, root = Tables(spark, folder), new_folder(spark)
    run = start_daily_usage(
        t.arriving_calls(), t.prices(), root, f"{root}/checkpoint", mode="update"
    )
    run.awaitTermination()
    rows = current_usage(spark.read.parquet(f"{root}/usage"))
    return rows.withColumn("cost_usd", F.col("cost_usd").cast("double"))


# anomalies --------------------------------------------------------------------


def spread_columns(rows: DataFrame) -> DataFrame:
    return spreads.spread_view(rows).withColumn("p90", F.round(F.col("p90").cast("double"), 4))


def category_spread(spark, folder):
    t = Tables(spark, folder)
    return spread_columns(spreads.category_spreads(t.receipts(), t.receipt_categories()))


def category_spread_by_currency(spark, folder):
    t = Tables(spark, folder)
    return spread_columns(spreads.category_spreads(t.receipts(), t.receipt_categories(), True))


def outlier_rows(tested: DataFrame, rows: DataFrame) -> DataFrame:
    reason = spreads.outlier_reason(F.col("total_amount"), F.col("currency"))
    amounts = tested.select("id", "total_amount", "currency")
    return rows.join(amounts, "id").select(
        "id", "category", "sample_size", F.round(F.col("p90").cast("double"), 6).alias("p90"),
        reason.alias("reason"),
    )


def outliers(spark, folder):
    t = Tables(spark, folder)
    rows = spreads.outliers(
        t.receipts(), t.receipts(), t.receipt_categories(), leave_self_out=True
    )
    return outlier_rows(t.receipts(), rows)


def outliers_snapshot(spark, folder):
    t = Tables(spark, folder)
    rows = spreads.outliers(t.batch(), t.history(), t.receipt_categories())
    return outlier_rows(t.batch(), rows)


def outliers_replay(spark, folder):
    t = Tables(spark, folder)
    rows = replay.replayed_outliers(t.receipts(), t.receipts(), t.receipt_categories())
    return outlier_rows(t.receipts(), rows)


def sketched_spread(spark, folder):
    """Per category the sketch of all days: how many totals, and whether the share of them up to its percentile is near 90 %."""
    t = Tables(spark, folder)
    counts = written(replay.daily_counts(t.receipts(), t.receipt_categories()))
    sketches = replay.daily_sketches(t.receipts(), t.receipt_categories())
    after = counts.groupBy("category").agg((F.max("day") + 1).alias("day"))
    found = replay.sketched_spreads_before(sketches, after).select("category", "sample_size", "p90")
    upto = F.sum(F.when(F.col("cents") <= F.round(F.col("p90") * 100), F.col("n")).otherwise(0))
    ranks = counts.join(found, "category").groupBy("category", "sample_size").agg((upto / F.sum("n")).alias("rank"))
    near = F.abs(F.col("rank") - 0.9) <= 0.03 + F.lit(1.0) / F.col("sample_size")
    return ranks.select("category", "sample_size", near.alias("near"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", F.col("match_id").alias("duplicate_of"), F.to_date("match_at").alias("submitted")
    )


def duplicates_replay(spark, folder):
    return duplicate_rows(duplicates.replay_duplicates(Tables(spark, folder).receipts()))


def duplicates_snapshot(spark, folder):
    t = Tables(spark, folder)
    return duplicate_rows(duplicates.snapshot_duplicates(t.batch(), t.history()))


def weekend_flags(spark, folder):
    rows = anomalies.weekend_flags(Tables(spark, folder).receipts())
    return rows.select("id", "is_suspicious", "flag_reason")


def missing_fields(spark, folder):
    return anomalies.missing_fields(Tables(spark, folder).receipts()).select("id", "missing_reason")


def reconcile_totals(spark, folder):
    t = Tables(spark, folder)
    rows = anomalies.unreconciled(t.receipts(), t.item_amounts())
    return rows.select("id", number("total_amount"), number("items_total"))


def verdict_rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", "is_suspicious", "flag_reason", "duplicate_of")


def verdict(spark, folder):
    t = Tables(spark, folder)
    completed = t.receipts().filter(F.col("status") == "completed")
    return verdict_rows(
        anomalies.verdicts(completed, completed, t.receipt_categories(), leave_self_out=True)
    )


def verdict_snapshot(spark, folder):
    t = Tables(spark, folder)
    return verdict_rows(anomalies.verdicts(t.batch(), t.history(), t.receipt_categories()))


# requests and reports ---------------------------------------------------------


def query_validation(spark, folder):
    rows = requests.parse_requests(Tables(spark, folder).requests("customer", "c_custkey"))
    return rows.select(
        "spec_id", "error", "from_day", "to_day", joined("wanted"), "needle",
        number("min_total"), number("max_total"),
    )


def query_batch(spark, folder):
    t = Tables(spark, folder)
    answers = requests.answer_requests(
        t.requests("supplier", "s_suppkey"), converted(t), t.receipt_categories()
    )
    lines = answers.select("spec_id", "error", F.explode_outer("result").alias("line"))
    return lines.select("spec_id", "error", "line.*").select(
        "spec_id", "error", "currency", "receipts", number("total"), number("total_eur"),
        "unconverted",
    )


def period_report(spark, folder):
    t = Tables(spark, folder)
    return insights.period_reports(t.periods(), converted(t), t.receipt_categories())


# intake and life-cycle --------------------------------------------------------


def media_types(spark, folder):
    content = F.col("content")
    return Tables(spark, folder).uploads().select(
        "id", image_type(content).alias("media_type"), is_pdf(content).alias("is_pdf")
    )


def upload_checks(spark, folder):
    checked = uploads.check_uploads(Tables(spark, folder).uploads())
    return checked.select("id", "reject_reason", "media_type")


def file_intake(spark, folder):
    checked = uploads.check_uploads(Tables(spark, folder).uploads())
    return uploads.pending_uploads(checked, F.lit("prompt")).select(
        "id", "status", "source_type", "source_filename",
        F.col("source_bytes").cast("bigint").alias("source_bytes"),
    )


def text_intake(spark, folder):
    """Documents as texts, some of them stretched to the limit by characters outside the basic plane."""
    pad = F.when(F.col("doc_id") % 7 == 1, 9_990).when(F.col("doc_id") % 7 == 2, 10_000).otherwise(0)
    text = F.when(pad == 0, F.col("text")).otherwise(
        F.concat(F.repeat(F.lit("\U0001F9FE"), pad), F.substring("text", 1, 10))
    )
    texts = Tables(spark, folder).table("documents").select(
        F.col("doc_id").alias("id"), text.alias("text"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    taken = uploads.pending_texts(texts, F.lit("prompt")).select(
        "id", "status", "source_type", F.md5("raw_text").alias("text_md5"), F.lit(None).cast("string").alias("reject_reason")
    )
    refused = uploads.rejected(uploads.check_texts(texts)).select(
        "id", F.lit("refused").alias("status"), F.lit("text").alias("source_type"), F.md5("text").alias("text_md5"), "reject_reason"
    )
    return taken.unionByName(refused)


def typed_parse(spark, folder):
    """Every field of the record; all null for a response that breaks the shape."""
    rows = extraction.parse(Tables(spark, folder).responses())
    plain = [f.name for f in EXTRACTION.fields if f.name not in ("line_items", "categories")]
    items = F.array_sort(F.transform("extraction.line_items", lambda i: F.concat_ws(
        "/", i["description"], i["quantity"].cast("bigint").cast("string"), i["category"])))
    return rows.select(
        "id", *[F.col(f"extraction.{name}") for name in plain],
        F.array_join("extraction.categories", "|").alias("categories"), F.array_join(items, "|").alias("line_items"),
    )


def triaged(spark, folder) -> DataFrame:
    return extraction.triage(extraction.parse(Tables(spark, folder).responses()))


def response_triage(spark, folder):
    return triaged(spark, folder).select("id", "failure_reason")


def merged_categories(spark, folder):
    return extraction.usable(triaged(spark, folder)).select("id", joined("categories"))


def completion_cast(spark, folder):
    rows = extraction.complete(Tables(spark, folder).responses())
    return rows.select(
        "id", "status", "failure_reason", "receipt_date", number("total_amount"), "currency",
        number("confidence_score"), joined("categories"), "is_suspicious", "flag_reason",
    )


def intake_in_two_batches(spark, folder):
    """Responses stored in two batches: open orders are judged against all others."""
    t, root = Tables(spark, folder), new_folder(spark)
    is_open = F.col("o_orderstatus") == "P"
    for batch, rows in enumerate((t.responses().filter(~is_open), t.responses().filter(is_open))):
        intake.take_in(rows, t.fx_rates(), root, batch)
    return spark.read.parquet(f"{root}/receipts").select(
        F.col("id").cast("bigint").alias("id"), "status", number("total_amount"),
        number("total_eur"), "is_suspicious", "flag_reason",
        F.col("duplicate_of").cast("bigint").alias("duplicate_of"),
    )


def intake_whole(spark, folder):
    """What one batch leaves: receipts with their source, the ledger with the calls of failed ones, category ids."""
    t, root = Tables(spark, folder), new_folder(spark)
    key = F.col("id")
    call = F.struct(
        F.when(key % 3 == 0, "m-a").otherwise("m-b-2").alias("model"), (key % 100).cast("int").alias("input_tokens"),
        F.lit(10).alias("output_tokens"), F.lit(0).alias("cache_read_input_tokens"), F.lit(1).alias("cache_creation_input_tokens"),
    )
    responses = t.responses().withColumn("calls", F.array_repeat(call, (key % 4).cast("int")))
    is_text = key % 5 < 2
    pending = t.responses().filter(key % 7 > 0).select(
        "id", F.when(is_text, F.concat(F.lit("receipt "), key.cast("string"))).alias("raw_text"), F.lit("prompt").alias("prompt_used"),
        F.when(is_text, "text").when(key % 5 == 2, "pdf").otherwise("image").alias("source_type"),
        F.when(~is_text, F.concat(F.lit("file-"), key.cast("string"))).alias("source_filename"),
        F.when(~is_text, (key % 1000).cast("int")).alias("source_bytes"),
        (F.col("created_at") - F.expr("interval 1 hour")).alias("created_at"),
    )
    intake.take_in(responses, t.fx_rates(), root, 0, pending)
    read = lambda table: spark.read.parquet(f"{root}/{table}")
    whole = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    receipts = read("receipts").select(
        F.lit("receipt").alias("part"), "id",
        F.concat_ws("/", "status", "source_type", whole(F.col("source_filename")), whole(F.col("source_bytes")), whole(F.col("raw_text")),
                    whole(F.col("prompt_used")), F.unix_timestamp("created_at").cast("string"), F.unix_timestamp("updated_at").cast("string")).alias("detail"),
    )
    ledger = read("calls").groupBy(F.col("receipt_id").alias("id")).agg(
        F.concat_ws("/", F.min("endpoint"), F.min("model"), F.count("*").cast("string"), F.count_distinct("request_id").cast("string"),
                    F.sum("input_tokens").cast("string"), F.sum("output_tokens").cast("string")).alias("detail")
    ).select(F.lit("call").alias("part"), "id", "detail")
    named = categories.named_bridge(read("bridge").select("receipt_id", "category_id"), read("categories"))
    bridge = categories.category_lists(named).select(F.lit("bridge").alias("part"), "id", joined("categories").alias("detail"))
    return receipts.unionByName(ledger).unionByName(bridge)


def latest_status(spark, folder):
    rows = lifecycle.latest_status(Tables(spark, folder).status_events())
    return rows.select("id", "status", F.unix_timestamp("updated_at").alias("updated_at"))


def status_stream(spark, folder):
    """The current status, kept in a state store while the orders arrive."""
    t, root = Tables(spark, folder), new_folder(spark)
    events = t.arriving("orders").status_events()
    state.start_status(events, root, f"{root}/checkpoint", retention="20000 days").awaitTermination()
    rows = state.current_status(spark.read.parquet(f"{root}/status"))
    return rows.select("id", "status", F.unix_timestamp("updated_at").alias("updated_at"))


def duplicates_stream(spark, folder):
    """Repeated submissions by the first copies that a state store keeps while the orders arrive."""
    t, root = Tables(spark, folder), new_folder(spark)
    state.start_first_copies(
        t.arriving("orders").receipts(), root, f"{root}/checkpoint", retention="20000 days"
    ).awaitTermination()
    firsts = state.current_first_copies(spark.read.parquet(f"{root}/first_copies"))
    return duplicate_rows(duplicates.linked(t.receipts(), firsts))


def untidy_bridge(t: Tables) -> DataFrame:
    """Category lists with blanks, outer spaces and repeats, back as a clean bridge."""
    lists = categories.category_lists(t.receipt_categories())
    padded = F.transform("categories", lambda c: F.concat(F.lit(" "), c, F.lit("  ")))
    untidy = lists.withColumn("categories", F.concat("categories", padded, F.array(F.lit("  "))))
    return categories.bridge_from_lists(untidy)


def stored_dimension(spark) -> DataFrame:
    rows = [(1, "Food"), (2, "Other"), (3, "Travel & Accommodation")]
    return spark.createDataFrame(rows, "id int, name string")


def category_bridge(spark, folder):
    bridge = untidy_bridge(Tables(spark, folder))
    # Stored once, so that it is not derived at every use and Spark knows how small it is.
    dimension = written(categories.extend_dimension(stored_dimension(spark), bridge))
    return categories.named_bridge(categories.bridge_ids(bridge, dimension), dimension)


def category_dimension(spark, folder):
    bridge = untidy_bridge(Tables(spark, folder))
    dimension = categories.extend_dimension(stored_dimension(spark), bridge)
    ids = dimension.agg(F.max("id").alias("last"), F.count_distinct("id").alias("ids"))
    last, count = ids.select("last").scalar(), ids.select("ids").scalar()
    return dimension.select(
        "name", (F.col("id") > 3).alias("is_new"), last.cast("bigint").alias("last_id"),
        count.alias("ids"),
    )


def ledger_rows(spark, folder):
    made = lifecycle.with_request_ids(Tables(spark, folder).call_requests(), "request_no")
    rows = lifecycle.ledger_rows(made)
    sizes = rows.groupBy("request_id").agg(F.count("*").alias("calls_in_request"))
    return rows.join(sizes, "request_id").drop("created_at")


def price_seed(spark, folder):
    listed = Tables(spark, folder).part_prices()
    rest = ["output", "cache_read", "cache_write"]
    key = ["model_prefix", "valid_from"]

    def one_per_key(rows: DataFrame, price: Column) -> DataFrame:
        return rows.groupBy(*key).agg(price.alias("input"), *[F.max(c).alias(c) for c in rest])

    seed = one_per_key(listed, F.max("input"))
    stored = one_per_key(listed.filter("p_size > 25"), F.min("input") / 2)
    rows = lifecycle.seed_prices(stored, seed)
    return rows.select(*key, F.round(F.col("input").cast("double"), 4).alias("input"))


def schema_backfill(spark, folder):
    older = Tables(spark, folder).receipts().drop("is_suspicious", "flag_reason")
    return lifecycle.to_schema(older, RECEIPTS).select(
        "id", "merchant", "status", "source_type", "is_suspicious", "flag_reason",
        F.col("source_bytes").cast("bigint").alias("source_bytes"), number("total_amount"),
    )


def delete_propagation(spark, folder):
    t = Tables(spark, folder)
    original = F.when(
        (F.col("id") >= 100_000_000) & (F.col("id") < 200_000_000), F.col("id") - 100_000_000
    )
    receipts = t.receipts().withColumn("duplicate_of", original)
    of_receipt = F.when(F.col("endpoint").isin("text", "pdf", "image"), F.col("id"))
    calls = t.calls().withColumn("receipt_id", of_receipt)
    deleted = receipts.filter("id % 80 = 0").select("id")
    left = lifecycle.delete_receipts(receipts, t.receipt_categories(), calls, deleted)

    def rows(part: str, key: str, detail: Column, reference: Column) -> DataFrame:
        return left[part].select(
            F.lit(part).alias("part"), F.col(key).alias("key"), detail.alias("detail"),
            reference.cast("bigint").alias("reference"),
        )

    none = F.lit(None)
    return (
        rows("receipts", "id", F.lit(""), F.col("duplicate_of"))
        .unionByName(rows("bridge", "receipt_id", F.col("category"), none))
        .unionByName(rows("calls", "id", F.lit(""), F.col("receipt_id")))
    )


# scoring ----------------------------------------------------------------------


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def category_scores(spark, folder):
    rows = scoring.label_scores(Tables(spark, folder).results())
    return rounded(rows, "precision", "recall", "f1")


def stored_scores(spark, folder):
    """Scores of labels as they come back from a stored evaluation."""
    results, root = Tables(spark, folder).results(), new_folder(spark)
    scores = {"labels": scoring.label_scores(results)}
    write_scores(scores, scoring.compared(results), root)
    shape = "category string, tp bigint, fp bigint, fn bigint, support bigint, precision double, recall double, f1 double"
    return rounded(spark.read.schema(shape).json(f"{root}/scores/labels"), "precision", "recall", "f1")


def micro_scores(spark, folder):
    labels = scoring.label_scores(Tables(spark, folder).results())
    return rounded(scoring.micro_scores(labels), "precision", "recall", "f1")


def exact_match(spark, folder):
    return rounded(scoring.exact_matches(Tables(spark, folder).results()), "exact_rate")


def source_summary(spark, folder):
    results = scoring.compared(scoring.unskipped(Tables(spark, folder).results()))
    return rounded(scoring.subset_summary(results, "source"), "exact_rate", "micro_f1")


def flag_scores(spark, folder):
    rows = scoring.flag_scores(Tables(spark, folder).flag_results())
    return rounded(rows, "precision", "recall", "f1", "accuracy")


def flag_mismatches(spark, folder):
    rows = scoring.flag_mismatches(Tables(spark, folder).flag_results())
    return rows.select("id", "expected_suspicious", "suspicious")


def pair_listing(spark, folder):
    return scoring.pairs(Tables(spark, folder).results()).select("id", "text_id", "paired")


def pair_scores(spark, folder):
    rows = scoring.pair_scores(scoring.pairs(Tables(spark, folder).results()))
    return rounded(rows, "exact_rate", "micro_f1")


def pair_delta(spark, folder):
    scores = scoring.pair_scores(scoring.pairs(Tables(spark, folder).results()))
    return rounded(scoring.pair_delta(scores), "exact_delta", "f1_delta").drop("pairs")


def mismatches(spark, folder):
    rows = scoring.mismatches(Tables(spark, folder).results())
    lists = [joined(c) for c in ("expected", "got", "missing", "spurious")]
    return rows.select("id", *lists, "error")


def first_cases(spark, folder):
    cases = Tables(spark, folder).table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position")
    )
    return filters.first_cases(cases, 100).select("id")


def score_report(spark, folder):
    """The whole report, every line with its number; some cases carry the evidence of their answer."""
    t = Tables(spark, folder)
    key = F.col("id") % 4
    cases = t.results().withColumns(
        {"position": F.col("id"), "evidence": F.when(key == 0, F.concat(F.lit("read from "), "input")).when(key == 1, "")}
    )
    flags = t.flag_results().withColumns({
        "position": F.col("id"), "input": F.concat(F.lit("document "), F.col("id").cast("string")),
        "flag_reason": F.when(F.col("suspicious"), "A short text."),
    })
    # The report reads the results many times, so they are stored once.
    return numbered(score_lines(written(cases), "whole table", written(flags)))


def all_queries():
    functions = [
        month_totals, category_totals, month_totals_eur, query_totals, query_totals_filtered,
        receipts_with_categories, spending_summary, insights_result, fx_asof, fx_asof_in_order, eur_conversion, response_view, receipt_lookup,
        price_asof, price_asof_in_order, usage_summary, usage_total, price_function, usage_stream,
        category_spread, category_spread_by_currency, outliers, outliers_snapshot, outliers_replay, sketched_spread,
        duplicates_replay, duplicates_snapshot, weekend_flags, missing_fields,
        reconcile_totals, verdict, verdict_snapshot,
        query_validation, query_batch, period_report,
        media_types, upload_checks, file_intake, text_intake, typed_parse, response_triage,
        merged_categories, completion_cast, intake_in_two_batches, intake_whole, latest_status, status_stream, duplicates_stream, category_bridge, category_dimension,
        ledger_rows, price_seed, schema_backfill, delete_propagation,
        category_scores, stored_scores, micro_scores, exact_match, source_summary, flag_scores,
        flag_mismatches, pair_listing, pair_scores, pair_delta, mismatches, first_cases,
        score_report,
    ]
    return {f.__name__: f for f in functions}
