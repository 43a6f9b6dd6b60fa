"""The period summary, and text reports for many periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import day_text, month_key
from ..functions.text import money_text, plural
from ..operators.categories import by_category
from ..operators.filters import Day, reportable
from ..operators.pricing import usage_summary
from ..operators.running import UPTO, running_sums
from ..operators.totals import category_totals, period
from ..sources.sinks import written
from .requests import REVERSED

#: Days per bucket of the running sums.
DAYS_WIDTH = 366.0

# The lines around the figures of a period report.
EMPTY_PERIOD = "No completed receipts fall in this period, so there is nothing to report on."
MONTH_HEADING = (
    "",
    "Totals per month, one line per month and currency. These count each",
    "receipt exactly once, so they are the only lines that may be added up:",
)
CATEGORY_HEADING = (
    "",
    "Totals per category, one line per category and currency. A receipt with",
    "more than one category is counted in full under each of them, so these",
    "lines overlap and must never be summed into a total:",
)
EUR_HEADING = (
    "",
    "Totals per month with every currency converted to EUR at the ECB rate on",
    "each receipt's date. This is the same spending as the month lines above,",
    "not additional spending. Each receipt is counted once, so these lines may",
    "be added up, and they are the only figures that combine currencies:",
)


# one period ---------------------------------------------------------------------


def month_lines(receipts: DataFrame, first: Day, last: Day) -> DataFrame:
    """Month and currency totals with their converted part: one pass for two reports."""
    return (
        period(receipts, first, last)
        .groupBy(month_key(F.col("receipt_date")).alias("month"), "currency")
        .agg(
            F.count("*").alias("receipts"),
            F.sum("total_amount").alias("total"),
            F.count("total_eur").alias("converted"),
            F.sum("total_eur").alias("total_eur"),
        )
    )


def spending_summary(
    receipts: DataFrame, bridge: DataFrame, first: Day, last: Day
) -> dict[str, DataFrame]:
    """The three aggregates of a period: categories, months, months in EUR."""
    lines = month_lines(receipts, first, last)
    months = lines.select("month", "currency", "receipts", "total")
    months_eur = lines.groupBy("month").agg(
        F.sum("converted").alias("receipts"),
        F.coalesce(F.sum("total_eur"), F.lit(0)).alias("total_eur"),
        (F.sum("receipts") - F.sum("converted")).alias("unconverted"),
    )
    return {
        "categories": category_totals(receipts, bridge, first, last),
        "months": months.orderBy("month", F.asc_nulls_last("currency")),
        "months_eur": months_eur.orderBy("month"),
    }


def summary_rows(summary: dict[str, DataFrame]) -> DataFrame:
    """The summary as one frame, a section name on every row."""
    none = F.lit(None).cast("bigint")

    def rows(part: str, section: str, name: str, currency: Column, total: str, left_out: Column):
        return summary[part].select(
            F.lit(section).alias("section"),
            F.col(name).alias("name"),
            currency.alias("currency"),
            "receipts",
            F.col(total).cast("double").alias("total"),
            left_out.alias("unconverted"),
        )

    months = rows("months", "month", "month", F.col("currency"), "total", none)
    eur = rows("months_eur", "month_eur", "month", F.lit("EUR"), "total_eur", F.col("unconverted"))
    categories = rows("categories", "category", "category", F.col("currency"), "total", none)
    return months.unionByName(eur).unionByName(categories)


def is_empty(summary: dict[str, DataFrame]) -> bool:
    """Nothing completed in the period: no month rows."""
    return summary["months"].isEmpty()


def period_insights(
    receipts: DataFrame, bridge: DataFrame, calls: DataFrame, prices: DataFrame, first: Day, last: Day
) -> DataFrame:
    """All that is told about one period, a ``section`` on every row: the summary, the usage of the model (name: endpoint and
    model, receipts: calls, total: USD, unconverted: calls without a price) and, for a period without receipts, one
    sentence instead of a text. A reversed period is refused with one row."""
    spark = receipts.sparkSession
    if str(first) > str(last):
        row = [("error", REVERSED, None, None, None, None)]
        return spark.createDataFrame(row, "section string, name string, currency string, receipts bigint, total double, unconverted bigint")
    summary = spending_summary(receipts, bridge, first, last)
    usage = usage_summary(calls, prices, first, last).select(
        F.lit("usage").alias("section"), F.concat_ws(" ", "endpoint", "model").alias("name"), F.lit("USD").alias("currency"),
        F.col("calls").alias("receipts"), F.col("cost_usd").cast("double").alias("total"), F.col("unpriced_calls").alias("unconverted"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    empty = summary["months"].limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("summary").alias("section"), F.lit(EMPTY_PERIOD).alias("name"), none("string").alias("currency"),
        none("bigint").alias("receipts"), none("double").alias("total"), none("bigint").alias("unconverted"),
    )
    return summary_rows(summary).unionByName(usage).unionByName(empty)


# many periods -------------------------------------------------------------------


def daily_totals(receipts: DataFrame) -> DataFrame:
    """Sums per day and currency: all that month lines of any period need. Its size follows the calendar."""
    dated = reportable(receipts).filter(F.col("receipt_date").isNotNull())
    return dated.groupBy("receipt_date", "currency").agg(
        F.count("*").alias("receipts"),
        F.sum("total_amount").alias("total"),
        F.count("total_eur").alias("converted"),
        F.sum("total_eur").alias("total_eur"),
    )


def daily_category_totals(receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    dated = reportable(receipts).filter(F.col("receipt_date").isNotNull())
    slim = dated.select("id", "receipt_date", "currency", "total_amount")
    return by_category(slim, bridge).groupBy("receipt_date", "category", "currency").agg(
        F.count("*").alias("receipts"), F.sum("total_amount").alias("total")
    )


def within_span(ranges: DataFrame, first: str, last: str, dated: DataFrame) -> DataFrame:
    """Ranges of days once per ``month``, clipped to the span of ``receipt_date`` (columns ``start``, ``end``)."""
    span = dated.agg(F.min("receipt_date").alias("low"), F.max("receipt_date").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    clipped = ranges.withColumns({"start": F.greatest(F.col(first), low), "end": F.least(F.col(last), high)}).filter(
        low.isNotNull() & (F.col("start") <= F.col("end"))
    )
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    return clipped.withColumn("month", F.explode(months))


def _up_to(daily: DataFrame, edges: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """The sums of each group's days up to each edge (group, ``edge``)."""
    points = daily.select(*group, F.col("receipt_date").alias("day"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])
    number = lambda c: F.unix_date(c).cast("bigint")
    found = running_sums(
        points.withColumn("place", number("day")).drop("day"),
        edges.select(*group, number("edge").alias("place"), F.lit(UPTO).alias("kind"), "edge"),
        group, "place", sums, DAYS_WIDTH,
    )
    return found.select(*group, "edge", *sums)


def _difference(asked: DataFrame, sums_up_to: DataFrame, group: list[str], join: list[str], sums: list[str]) -> DataFrame:
    """Asked ranges (``low``, ``high`` edges) with the sums of their days, per group that has any."""
    upper = asked.join(sums_up_to.withColumnRenamed("edge", "high"), [*join, "high"])
    lower = sums_up_to.select(*[F.col(c).alias(f"_{c}") for c in (*group, "edge", *sums)])
    same = F.col("low") == F.col("_edge")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = upper.join(lower, same, "left")
    rest = [(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums]
    return both.select("period_id", *group, *rest).filter("receipts > 0")


def months_in_periods(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Sums per period, month and currency: differences of the running sums inside a month.

    A month that lies whole in a period is met at its last day, like in every other period.
    """
    sums = ["receipts", "total", "converted", "total_eur"]
    group = ["month", "currency"]
    spread = within_span(periods.filter(F.col("first") <= F.col("last")), "first", "last", daily)
    asked = spread.select(
        "period_id", "month",
        F.when(F.col("start") > F.col("month"), F.date_sub("start", 1)).alias("low"),
        F.least("end", F.last_day("month")).alias("high"),
    )
    monthly = daily.withColumn("month", F.trunc("receipt_date", "month"))
    edges = asked.select("month", F.explode(F.array_compact(F.array("low", "high"))).alias("edge")).distinct()
    edges = edges.join(monthly.select(*group).distinct(), "month")
    return _difference(asked, _up_to(monthly, edges, group, sums), group, ["month"], sums)


def categories_in_periods(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Sums per period, category and currency: differences of two lookups in the running sums since the first day.

    An edge meets the groups that its year or an earlier one has, so that it needs no other key to find them.
    """
    sums, group = ["receipts", "total"], ["category", "currency"]
    span = daily.agg(F.min("receipt_date").alias("low"), F.max("receipt_date").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    asked = periods.filter(F.col("first") <= F.col("last")).filter((F.col("first") <= high) & (F.col("last") >= low)).select(
        "period_id", F.when(F.col("first") > low, F.date_sub("first", 1)).alias("low"), F.least("last", high).alias("high")
    )
    edges = asked.select(F.explode(F.array_compact(F.array("low", "high"))).alias("edge")).distinct()
    since = daily.groupBy(*group).agg(F.year(F.min("receipt_date")).alias("since"))
    known = since.select(*group, F.explode(F.sequence("since", F.year(high))).alias("year"))
    edges = edges.withColumn("year", F.year("edge")).join(known, "year").drop("year")
    return _difference(asked, _up_to(daily, edges, group, sums), group, [], sums)


def _in_order(*keys: Column, line: Column) -> Column:
    """Lines of a period, ordered by the keys (their number follows the calendar)."""
    rank = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], line.alias("line"))
    return F.transform(F.array_sort(F.collect_list(rank)), lambda x: x.getField("line"))


def _currency_last() -> tuple[Column, Column]:
    return F.col("currency").isNull(), F.col("currency")


def _over(name: str, amount: str, currency: Column) -> Column:
    return F.concat(
        F.lit("- "),
        F.col(name),
        F.lit(": "),
        money_text(F.col(amount), currency),
        F.lit(" over "),
        plural(F.col("receipts"), "receipt"),
    )


def _section(heading: tuple[str, ...], lines: Column) -> Column:
    return F.concat(F.array(*[F.lit(h) for h in heading]), lines)


def _left_out(count: Column) -> Column:
    note = F.concat(
        F.lit(" ("),
        plural(count, "receipt"),
        F.lit(" could not be converted and "),
        F.when(count == 1, "is").otherwise("are"),
        F.lit(" left out)"),
    )
    return F.when(count > 0, note).otherwise("")


def _month_parts(periods: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Month lines and EUR lines of every period, from the same day sums."""
    month = month_key(F.col("month")).alias("month")
    found = months_in_periods(periods, daily)
    per_month = found.select("period_id", month, "currency", "receipts", "total", "converted", "total_eur")
    months = per_month.groupBy("period_id").agg(
        _in_order(
            F.col("month"), *_currency_last(), line=_over("month", "total", F.col("currency"))
        ).alias("month_lines")
    )
    per_month_eur = per_month.groupBy("period_id", "month").agg(
        (F.sum("receipts") - F.sum("converted")).alias("unconverted"),
        F.sum("converted").alias("receipts"),
        F.coalesce(F.sum("total_eur"), F.lit(0)).alias("total_eur"),
    )
    line = F.concat(_over("month", "total_eur", F.lit("EUR")), _left_out(F.col("unconverted")))
    eur = per_month_eur.groupBy("period_id").agg(
        _in_order(F.col("month"), line=line).alias("eur_lines"),
        F.sum("receipts").alias("converted"),
    )
    return months, eur


def _category_part(periods: DataFrame, daily: DataFrame) -> DataFrame:
    per_category = categories_in_periods(periods, daily)
    line = _over("category", "total", F.col("currency"))
    return per_category.groupBy("period_id").agg(
        _in_order(-F.col("total"), F.col("category"), *_currency_last(), line=line).alias(
            "category_lines"
        )
    )


def period_reports(periods: DataFrame, receipts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per period (period_id, first, last): ``error`` or the text block ``report``."""
    # Day sums are used several times and are small; stored, each is computed once.
    months, eur = _month_parts(periods, written(daily_totals(receipts)))
    categories = _category_part(periods, written(daily_category_totals(receipts, bridge)))
    none = F.array().cast("array<string>")
    heading = F.concat(
        F.lit("Period: "),
        day_text(F.col("first")),
        F.lit(" to "),
        day_text(F.col("last")),
        F.lit(" (inclusive)."),
    )
    block = F.concat(
        F.array(heading),
        _section(MONTH_HEADING, F.col("month_lines")),
        _section(CATEGORY_HEADING, F.coalesce("category_lines", none)),
        F.when(F.col("converted") > 0, _section(EUR_HEADING, F.col("eur_lines"))).otherwise(none),
    )
    joined = (
        periods.join(months, "period_id", "left")
        .join(categories, "period_id", "left")
        .join(eur, "period_id", "left")
    )
    is_reversed = F.col("first") > F.col("last")
    report = F.when(F.col("month_lines").isNull(), EMPTY_PERIOD).otherwise(
        F.array_join(block, "\n")
    )
    return joined.select(
        "period_id",
        F.when(is_reversed, REVERSED).alias("error"),
        F.when(~is_reversed, report).alias("report"),
    )
