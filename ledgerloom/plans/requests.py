"""Batches of total requests: checked first, then answered together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import real_day
from ..functions.labels import in_taxonomy
from ..functions.numbers import valid_amount
from ..functions.text import strip, utf16_length
from ..operators.categories import with_categories
from ..operators.filters import reportable
from ..operators.joining import fits
from ..operators.needles import holders
from ..operators.running import BELOW, UPTO, block_at, blocks_in, day_place, running_sums
from ..operators.totals import eur_columns
from ..schemas import MAX_MERCHANT_CHARS, TAXONOMY
from ..sources.sinks import written

# Argument names and the sentences that refuse a request.
KEYS = ("from", "to", "categories", "merchant", "min_total", "max_total")
NOT_AN_OBJECT = "The arguments must be an object."
UNKNOWN_KEYS = "Unknown argument(s): "
NOT_REAL_DAYS = '"from" and "to" must be real dates written as YYYY-MM-DD.'
REVERSED = '"from" must not be later than "to".'
BAD_CATEGORIES = f'"categories" must be null or a list drawn from: {", ".join(TAXONOMY)}.'
BAD_MERCHANT = '"merchant" must be a string or null.'
LONG_MERCHANT = f'"merchant" must be at most {MAX_MERCHANT_CHARS} characters.'
BAD_AMOUNTS = '"min_total" and "max_total" must be null or non-negative numbers.'
MIN_ABOVE_MAX = '"min_total" must not be larger than "max_total".'

NUMBER_TYPES = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"

RESULT_TYPE = (
    "array<struct<currency:string,receipts:bigint,total:decimal(22,2),"
    "total_eur:decimal(22,2),unconverted:bigint>>"
)


def read_arguments(requests: DataFrame) -> DataFrame:
    """Parse each request once and read every argument with its JSON type.

    The parsed value goes through ``explode`` so that later columns refer to it instead
    of parsing the text again. A missing key reads as a null value.
    """
    parsed = requests.withColumn("_input", F.explode(F.array(F.try_parse_json("input"))))
    path = lambda key, kind: F.try_variant_get("_input", f"$.{key}", kind)
    kind_of = lambda key: F.coalesce(F.schema_of_variant(path(key, "variant")), F.lit("VOID"))
    columns = {f"{key}_type": kind_of(key) for key in KEYS}
    columns |= {f"{key}_text": path(key, "string") for key in ("from", "to", "merchant")}
    columns |= {f"{key}_number": path(key, "double") for key in ("min_total", "max_total")}
    columns["listed"] = path("categories", "array<string>")
    columns["keys"] = F.array_distinct(F.json_object_keys("input"))
    typed = parsed.withColumns(columns)
    keep_if = lambda value, ok: F.when(ok, value)
    is_text = lambda key: F.col(f"{key}_type") == "STRING"
    is_number = lambda key: F.col(f"{key}_type").rlike(NUMBER_TYPES)
    is_list = F.col("categories_type").startswith("ARRAY")
    return typed.withColumns(
        {
            "from_day": keep_if(real_day(F.col("from_text")), is_text("from")),
            "to_day": keep_if(real_day(F.col("to_text")), is_text("to")),
            "needle": keep_if(strip(F.col("merchant_text")), is_text("merchant")),
            "low": keep_if(F.col("min_total_number"), is_number("min_total")),
            "high": keep_if(F.col("max_total_number"), is_number("max_total")),
            "listed": keep_if(F.col("listed"), is_list),
            "unknown": F.array_except("keys", F.array(*[F.lit(k) for k in KEYS])),
        }
    )


def first_problem() -> Column:
    """The first failing check of a request, in a fixed order; null when it is fine."""
    given = lambda key: F.col(f"{key}_type") != "VOID"
    amount_ok = lambda c: F.coalesce(valid_amount(F.col(c)), F.lit(False))
    bad_low = given("min_total") & ~amount_ok("low")
    bad_high = given("max_total") & ~amount_ok("high")
    unknown = F.concat(F.lit(UNKNOWN_KEYS), F.array_join("unknown", ", "), F.lit("."))
    return (
        F.when(F.col("_input").isNull() | F.col("keys").isNull(), NOT_AN_OBJECT)
        .when(F.size("unknown") > 0, unknown)
        .when(F.col("from_day").isNull() | F.col("to_day").isNull(), NOT_REAL_DAYS)
        .when(F.col("from_day") > F.col("to_day"), REVERSED)
        .when(given("categories") & ~in_taxonomy(F.col("listed")), BAD_CATEGORIES)
        .when(~F.col("merchant_type").isin("VOID", "STRING"), BAD_MERCHANT)
        .when(utf16_length(F.col("needle")) > MAX_MERCHANT_CHARS, LONG_MERCHANT)
        .when(bad_low | bad_high, BAD_AMOUNTS)
        .when(F.col("low") > F.col("high"), MIN_ABOVE_MAX)
    )


def parse_requests(requests: DataFrame) -> DataFrame:
    """Check JSON requests (spec_id, input): ``error`` is the first failure, or null.

    Accepted requests get typed arguments, where null always means "no filter": a
    blank merchant and an empty category list do too.
    """
    # Through explode as well: filters on ``error`` then stay simple column filters.
    checked = read_arguments(requests).withColumn("error", F.explode(F.array(first_problem())))
    usable = lambda value: F.when(F.col("error").isNull(), value)
    return checked.select(
        "spec_id",
        "input",
        "error",
        usable(F.col("from_day")).alias("from_day"),
        usable(F.col("to_day")).alias("to_day"),
        usable(F.when(F.size("listed") > 0, F.col("listed"))).alias("wanted"),
        usable(F.when(F.col("needle") != "", F.col("needle"))).alias("needle"),
        usable(F.col("low")).alias("min_total"),
        usable(F.col("high")).alias("max_total"),
    )


# Which receipts a request can meet, by the filters it sets: all, those of a set of categories, or those of a merchant.
ANY, SETS, MERCHANT = "any", "sets", "merchant"
SUMS = ["receipts", "total", "total_eur", "unconverted"]
#: Amounts per bucket of the running sums: a million cents.
AMOUNT_WIDTH = 10_000.0
#: Beyond every amount of a receipt.
HIGHEST = 1e15
#: Distinct day blocks that are broadcast, 20 bytes each; more are shuffled.
MAX_BROADCAST_BLOCKS = 1 << 20


def asked_blocks(parsed: DataFrame) -> DataFrame:
    """Accepted requests once per day block of their range: at most two blocks a size, however long the range.

    ``scope`` says what else selects their receipts, ``valued`` whether an amount does.
    """
    scope = F.when(F.col("needle").isNotNull(), MERCHANT).when(F.col("wanted").isNotNull(), SETS).otherwise(ANY)
    block = F.explode(blocks_in(day_place(F.col("from_day")), day_place(F.col("to_day")))).alias("_at")
    rows = parsed.filter(F.col("error").isNull()).select(
        "spec_id",
        scope.alias("scope"),
        (F.col("min_total").isNotNull() | F.col("max_total").isNotNull()).alias("valued"),
        "wanted", "needle", "min_total", "max_total", block,
    )
    # Requests for the same merchants and categories share their sums.
    shared = F.when(F.col("scope") == MERCHANT, F.to_json(F.struct("needle", "wanted"))).alias("filter")
    return rows.select("*", shared, "_at.*").drop("_at")


def _day_points(receipts: DataFrame, bridge: DataFrame, kinds: dict, merchants: DataFrame | None) -> DataFrame:
    """Sums per day of every kind (scope, valued) of request that was asked."""
    slim = reportable(receipts).filter(F.col("receipt_date").isNotNull()).select(
        "id", "merchant", "receipt_date", "total_amount", "total_eur", "currency"
    )
    scopes = {scope for scope, _ in kinds}
    rows = slim
    if scopes & {SETS, MERCHANT}:
        rows = with_categories(slim, bridge)
    else:
        rows = rows.withColumn("categories", F.array().cast("array<string>"))
    if merchants is not None:
        named = merchants.select(F.col("text").alias("merchant"), F.lit(True).alias("named")).distinct()
        rows = rows.join(named, "merchant", "left")
    none = F.lit(None).cast("array<string>")
    key_of = {
        ANY: (F.lit(""), none, F.lit(True)),
        SETS: (F.array_join("categories", "|"), F.col("categories"), F.size("categories") > 0),
        MERCHANT: (F.col("merchant"), F.col("categories"), F.col("named") if merchants is not None else F.lit(False)),
    }
    value = lambda valued: F.col("total_amount").cast("double") if valued else F.lit(None).cast("double")
    forms = [
        F.when(
            key_of[scope][2],
            F.struct(
                F.lit(scope).alias("scope"), F.lit(valued).alias("valued"), key_of[scope][0].alias("key"),
                key_of[scope][1].alias("sets"), value(valued).alias("value"),
            ),
        )
        for scope, valued in kinds
    ]
    spread = rows.withColumn("_form", F.explode(F.array_compact(F.array(*forms))))
    return spread.groupBy("_form", "currency", day_place(F.col("receipt_date")).alias("place")).agg(
        F.count("*").alias("receipts"), F.sum("total_amount").alias("total"), *eur_columns()
    ).select("_form.*", "currency", "place", *SUMS)


def _block_points(days: DataFrame, asked: DataFrame, kinds: dict, merchants: DataFrame | None) -> DataFrame:
    """Sums of the day blocks that some request has; those of merchants for each filter of needle and categories."""
    levels = F.lit(None).cast("array<int>")
    for (scope, valued), used in kinds.items():
        same = (F.col("scope") == scope) & (F.col("valued") == valued)
        levels = F.when(same, F.array(*[F.lit(level) for level in sorted(used)])).otherwise(levels)
    at = days.withColumn("level", F.explode(levels)).withColumn("block", block_at(F.col("place"), F.col("level")))
    place = ["scope", "valued", "level", "block"]

    def bounded(blocks: DataFrame) -> DataFrame:
        return F.broadcast(blocks) if fits(blocks, MAX_BROADCAST_BLOCKS) else blocks

    met = at.filter(F.col("scope") != MERCHANT).join(bounded(asked.select(*place).distinct()), place, "left_semi")
    if merchants is not None:
        of = asked.filter(F.col("scope") == MERCHANT).select(*place, "needle", "wanted", "filter").distinct()
        named = at.filter(F.col("scope") == MERCHANT).join(merchants.select("needle", F.col("text").alias("key")), "key")
        found = named.join(bounded(of), [*place, "needle"]).filter(F.col("wanted").isNull() | F.arrays_overlap("sets", "wanted"))
        none = F.lit(None).cast("array<string>")
        met = met.unionByName(found.withColumns({"key": F.col("filter"), "sets": none}).select(*met.columns))
    key = ["scope", "valued", "key", "sets", "currency", "level", "block", "value"]
    return met.groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS])


def _keyed(asked: DataFrame, points: DataFrame, kinds: dict) -> DataFrame:
    """Asked blocks with the key of the sums they meet: '', each set of categories with a wanted name, or their filter."""
    scopes = {scope for scope, _ in kinds}
    rows = asked.filter(F.col("scope") == ANY).withColumn("key", F.lit(""))
    if SETS in scopes:
        of = asked.filter(F.col("scope") == SETS)
        sets = points.filter(F.col("scope") == SETS).select("key", F.explode("sets").alias("name"))
        names = of.select("wanted", F.explode("wanted").alias("name")).distinct()
        met = names.join(sets.distinct(), "name").select("wanted", "key").distinct()
        rows = rows.unionByName(of.join(met, "wanted"))
    if MERCHANT in scopes:
        rows = rows.unionByName(asked.filter(F.col("scope") == MERCHANT).withColumn("key", F.col("filter")))
    return rows


def request_totals(parsed: DataFrame, receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    """(spec_id, currency) with the sums of the receipts each accepted request lets through.

    No request meets receipts: it meets sums per day block, by equality, of everything, of the sets of categories that
    have a wanted name, or of the receipts that its needle and categories let through; requests that share these share the sums. Amount limits are differences of running sums
    along the amounts of such a block.
    """
    asked = written(asked_blocks(parsed))
    kinds: dict[tuple[str, bool], set[int]] = {}
    # At most six kinds times the number of block sizes.
    for row in asked.select("scope", "valued", "level").distinct().collect():
        kinds.setdefault((row.scope, row.valued), set()).add(row.level)
    merchants = None
    if any(scope == MERCHANT for scope, _ in kinds):
        texts = reportable(receipts).select(F.col("merchant").alias("text"))
        merchants = written(holders(asked.select("needle"), texts))
    points = written(_block_points(_day_points(receipts, bridge, kinds, merchants), asked, kinds, merchants)) if kinds else None
    if points is None:
        money = "decimal(38,2)"
        return parsed.limit(0).select(
            "spec_id", F.lit("").alias("currency"), F.lit(0).cast("bigint").alias("receipts"), F.lit(0).cast(money).alias("total"),
            F.lit(0).cast(money).alias("total_eur"), F.lit(0).cast("bigint").alias("unconverted"),
        )
    keyed = _keyed(asked, points, kinds)
    place = ["scope", "valued", "key", "level", "block"]
    whole = keyed.filter("not valued").join(points.filter("not valued"), place).select("spec_id", "currency", *SUMS)

    group = [*place, "sets", "currency"]
    valued = points.filter("valued")
    met = keyed.filter("valued").join(valued.select(*group).distinct(), place)
    limit = lambda bound, kind, sign: F.when(
        bound.isNotNull(),
        F.struct(F.least(bound, F.lit(HIGHEST)).alias("value"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign")),
    )
    limits = F.array_compact(F.array(
        limit(F.col("min_total"), BELOW, -1), limit(F.coalesce("max_total", F.lit(HIGHEST)), UPTO, 1)
    ))
    lookups = met.select("spec_id", *group, F.explode(limits).alias("_limit")).select("spec_id", *group, "_limit.*")
    upto = running_sums(valued, lookups, group, "value", SUMS, AMOUNT_WIDTH)
    within = upto.select("spec_id", "currency", *[(F.col(c) * F.col("sign")).alias(c) for c in SUMS])
    totals = whole.unionByName(within).groupBy("spec_id", "currency").agg(*[F.sum(c).alias(c) for c in SUMS])
    return totals.filter("receipts > 0")


def answer_requests(requests: DataFrame, receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every request with ``error`` or with ``result``, its totals per currency.

    A refused request never meets the data; an accepted one that matches nothing gets
    an empty result.
    """
    parsed = written(parse_requests(requests))
    totals = request_totals(parsed, receipts, bridge)
    totals = totals.withColumns({c: F.col(c).cast("decimal(22,2)") for c in ("total", "total_eur")})
    line = F.struct(
        F.col("currency").isNull().alias("last"),
        "currency", "receipts", "total", "total_eur", "unconverted",
    )
    results = totals.groupBy("spec_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    fields = ("currency", "receipts", "total", "total_eur", "unconverted")
    without_rank = F.transform(
        "lines", lambda x: F.struct(*[x.getField(f).alias(f) for f in fields])
    )
    answered = parsed.select("spec_id", "input", "error").join(results, "spec_id", "left")
    result = F.coalesce(without_rank, F.array().cast(RESULT_TYPE))
    return answered.select(
        "spec_id", "input", "error", F.when(F.col("error").isNull(), result).alias("result")
    )
