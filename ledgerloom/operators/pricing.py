"""The usage ledger priced by a versioned, longest-prefix price list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numbers import per_million
from ..schemas import TOKEN_PRICES
from .filters import Day, called_between
from ..sources.sinks import written
from .asof import latest_before
from .joining import fits, salted_lookup

MAX_BROADCAST_INTERVALS = 100_000
PRICE_COLUMNS = list(TOKEN_PRICES.values())


def price_intervals(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model, which price row holds in which date interval.

    A model is matched through its own prefixes, so the match is an equality join and
    every character of a prefix is literal. At each date a price starts, the winner is
    the longest prefix valid by then and, within it, the latest start - a longer prefix
    that has not started yet leaves the shorter one in force.
    """
    prefixes = models.select(
        "model",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("model")), lambda n: F.left(F.col("model"), n)
            )
        ).alias("model_prefix"),
    )
    matched = prefixes.join(prices, "model_prefix")
    started = (
        Window.partitionBy("model")
        .orderBy("valid_from")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rank = F.struct(F.length("model_prefix").alias("size"), "valid_from", "model_prefix", *PRICE_COLUMNS)
    winners = matched.select(
        "model", F.col("valid_from").alias("starts"), F.max(rank).over(started).alias("best")
    ).dropDuplicates(["model", "starts"])
    following = F.lead("starts").over(Window.partitionBy("model").orderBy("starts"))
    return winners.select(
        F.col("model").alias("priced_model"),
        "starts",
        following.alias("ends"),
        "best.model_prefix",
        F.col("best.valid_from").alias("valid_from"),
        *[F.col(f"best.{c}").alias(c) for c in PRICE_COLUMNS],
    )


def in_force(day: Column) -> Column:
    return (day >= F.col("starts")) & (F.col("ends").isNull() | (day < F.col("ends")))


def of_model() -> Column:
    return F.col("model") == F.col("priced_model")


def price_calls(calls: DataFrame, prices: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Each call with the price in force when it was made; unpriced calls stay, with nulls.

    A price starts at midnight UTC, so the call's day decides. The interval table has
    models x price changes rows; it is broadcast when a bounded count shows it is small,
    and otherwise joined on the model with the calls of hot models spread.
    """
    models = calls.select("model").distinct() if models is None else models
    # Stored once: the ledger is read for its models here, and for the join.
    intervals = written(price_intervals(models, prices))
    on_day = in_force(F.to_date("created_at"))
    if fits(intervals, MAX_BROADCAST_INTERVALS):
        joined = calls.join(F.broadcast(intervals), of_model() & on_day, "left")
    else:
        by_model = intervals.withColumnRenamed("priced_model", "model")
        joined = salted_lookup(calls, by_model, ["model"], "id", extra=on_day)
    return joined.drop("priced_model", "starts", "ends")


#: Microseconds per bucket of the sorted lookup: a week.
PRICE_SPAN = 7 * 86_400_000_000


def price_calls_in_order(calls: DataFrame, prices: DataFrame, salts: int = 1) -> DataFrame:
    """As ``price_calls``, by sorting calls and price changes together: for price lists of any size and moments of any kind."""
    names = ["model_prefix", "valid_from", *PRICE_COLUMNS]
    changes = price_intervals(calls.select("model").distinct(), prices).select(
        F.col("priced_model").alias("model"), F.unix_micros(F.col("starts").cast("timestamp")).alias("since"), *names
    )
    found = latest_before(calls.withColumn("_at", F.unix_micros("created_at")), changes, ["model"], "_at", "since", PRICE_SPAN, salts)
    return found.select(*calls.columns, *[F.col("fact")[n].alias(n) for n in names])


def daily_usage(calls: DataFrame) -> DataFrame:
    """Calls and token sums per endpoint, model and day.

    Prices change at midnight only, so pricing these sums gives exactly the cost of
    pricing every call, and the ledger is reduced before anything is joined.
    """
    return calls.groupBy("endpoint", "model", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("calls"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in TOKEN_PRICES],
    )


def priced_days(daily: DataFrame, prices: DataFrame) -> DataFrame:
    intervals = price_intervals(daily.select("model").distinct(), prices)
    return daily.join(intervals, of_model() & in_force(F.col("day")), "left")


def cost(tokens: dict[str, str] = TOKEN_PRICES) -> Column:
    parts = [F.col(c).cast("decimal(18,0)") * F.col(p) for c, p in tokens.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def usage_lines(priced: DataFrame) -> DataFrame:
    """Per endpoint and model: calls, tokens, cost of the priced calls, unpriced calls."""
    lines = priced.groupBy("endpoint", "model").agg(
        F.sum("calls").alias("calls"),
        *[F.sum(c).alias(c) for c in TOKEN_PRICES],
        per_million(F.sum(cost())).alias("cost_usd"),
        F.coalesce(
            F.sum(F.when(F.col("model_prefix").isNull(), F.col("calls"))), F.lit(0)
        ).alias("unpriced_calls"),
    )
    return lines.orderBy("endpoint", "model")


def usage_summary(calls: DataFrame, prices: DataFrame, first: Day, last: Day) -> DataFrame:
    return usage_lines(priced_days(daily_usage(called_between(calls, first, last)), prices))


def usage_total(lines: DataFrame) -> DataFrame:
    """One row: cost of everything priced, and the calls left out of it."""
    return lines.agg(
        F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0)).alias("total_cost_usd"),
        F.coalesce(F.sum("unpriced_calls"), F.lit(0)).alias("unpriced_calls"),
    )


def register_price_function(spark: SparkSession, prices: DataFrame) -> None:
    """Make ``model_price_at(model, at)`` usable in SQL: no row or one price row.

    A model meets the list through its own prefixes, so the planner has an equality to join on.
    """
    prices.createOrReplaceTempView("model_prices")
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION model_price_at(p_model STRING, p_at TIMESTAMP)
        RETURNS TABLE (model_prefix STRING, valid_from DATE, input DECIMAL(10,4),
                       output DECIMAL(10,4), cache_read DECIMAL(10,4), cache_write DECIMAL(10,4))
        RETURN
          SELECT model_prefix, valid_from, input, output, cache_read, cache_write
          FROM (SELECT explode(transform(sequence(0, length(p_model)), n -> left(p_model, n))) AS prefix)
          JOIN model_prices ON model_prefix = prefix
          WHERE valid_from <= p_at
          ORDER BY length(model_prefix) DESC, valid_from DESC
          LIMIT 1
        """
    )
