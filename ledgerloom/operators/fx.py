"""Conversion to EUR with a backward as-of lookup on a published rate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import to_money
from ..schemas import RATE
from .asof import latest_before

BASE_CURRENCY = "EUR"


def published(rates: DataFrame) -> DataFrame:
    """One rate per currency and published day."""
    return rates.groupBy("currency", "rate_date").agg(F.max("rate").alias("rate"))


def daily_rates(rates: DataFrame) -> DataFrame:
    """Every calendar day between two published days, with the earlier day's rate.

    Filling the gaps turns the as-of lookup into a plain equality join on
    (currency, day). The result has currencies x calendar days rows - it grows with
    the calendar, not with the receipts.
    """
    following = F.lead("rate_date").over(Window.partitionBy("currency").orderBy("rate_date"))
    until = F.coalesce(F.date_sub(F.col("following"), 1), F.col("rate_date"))
    return published(rates).withColumn("following", following).select(
        F.col("currency").alias("fx_currency"),
        F.explode(F.sequence("rate_date", until)).alias("fx_day"),
        F.col("rate").cast(RATE).alias("day_rate"),
        F.col("rate_date").alias("day_date"),
    )


def latest_rates(rates: DataFrame) -> DataFrame:
    """The last published rate per currency, for undated receipts and later days."""
    return published(rates).groupBy(F.col("currency").alias("last_currency")).agg(
        F.max("rate_date").alias("last_date"),
        F.max_by(F.col("rate").cast(RATE), "rate_date").alias("last_rate"),
    )


def folded(currency: Column) -> Column:
    """The code used for the rate lookup only; the stored code stays as it was."""
    return F.upper(F.trim(currency))


def with_rate(receipts: DataFrame, rates: DataFrame, today: Column | None = None) -> DataFrame:
    """Add ``fx_rate`` and ``fx_date``: the rate on the receipt date or before it.

    EUR is rate 1 on its own date (``today`` when undated). A receipt without total
    or currency, or in a currency without a rate by then, gets nulls. Neither join is
    hinted: Spark broadcasts the rate table when it fits its own size check and
    otherwise shuffles on (currency, day), which spreads any one currency by date.
    """
    keyed = receipts.withColumn("_base", _base_of())
    on_day = keyed.join(
        daily_rates(rates),
        (F.col("_base") == F.col("fx_currency")) & (F.col("receipt_date") == F.col("fx_day")),
        "left",
    )
    return _rated(on_day, receipts.columns, rates, today)


#: Days per bucket of the sorted lookup.
RATE_DAYS = 32


def with_rate_in_order(receipts: DataFrame, rates: DataFrame, today: Column | None = None, salts: int = 1) -> DataFrame:
    """As ``with_rate``, by sorting receipts and rates together: no row per calendar day, for rates that come at any distance."""
    keyed = receipts.withColumns({"_base": _base_of(), "_at": F.unix_date("receipt_date")})
    facts = published(rates).select(
        F.col("currency").alias("_base"), F.unix_date("rate_date").alias("since"), F.col("rate").cast(RATE).alias("rate"), "rate_date"
    )
    found = latest_before(keyed, facts, ["_base"], "_at", "since", RATE_DAYS, salts)
    dated = found.select("*", F.col("fact.rate").alias("day_rate"), F.col("fact.rate_date").alias("day_date"))
    return _rated(dated, receipts.columns, rates, today)


def _base_of() -> Column:
    wanted = F.col("total_amount").isNotNull() & (F.length("currency") > 0)
    return F.when(wanted, folded(F.col("currency")))


def _rated(on_day: DataFrame, columns: list[str], rates: DataFrame, today: Column | None) -> DataFrame:
    """The receipt's columns with rate and date, from the rate of its day (``day_rate``, ``day_date``) or the last one."""
    today = F.current_date() if today is None else today
    on_last = on_day.join(
        latest_rates(rates), F.col("_base") == F.col("last_currency"), "left"
    )
    is_base = F.col("_base") == BASE_CURRENCY
    use_last = F.col("receipt_date").isNull() | (F.col("receipt_date") > F.col("last_date"))
    rate = (
        F.when(is_base, F.lit(1).cast(RATE))
        .when(use_last, F.col("last_rate"))
        .otherwise(F.col("day_rate"))
    )
    rate_date = (
        F.when(is_base, F.coalesce("receipt_date", today))
        .when(use_last, F.col("last_date"))
        .otherwise(F.col("day_date"))
    )
    return on_last.select(
        *[F.col(c) for c in columns if c not in ("fx_rate", "fx_date")],
        rate.alias("fx_rate"),
        rate_date.alias("fx_date"),
    )


def with_eur(receipts: DataFrame, rates: DataFrame, today: Column | None = None) -> DataFrame:
    """Add the rate and ``total_eur``, rounded to cents only after multiplying."""
    rated = with_rate(receipts.drop("total_eur"), rates, today)
    return rated.withColumn("total_eur", to_money(F.col("total_amount") * F.col("fx_rate")))
