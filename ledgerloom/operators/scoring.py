"""Scores of multi-label predictions and of one boolean flag against labels.

Results have: id, source, same_as, expected, got, skipped, error (null when absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import hits, missing, same_labels, spurious
from ..functions.numbers import f1_score, ratio
from .joining import salted_lookup

IMAGE = "image"


def compared(results: DataFrame) -> DataFrame:
    """Add ``exact``, ``missing``, ``spurious``; an unanswered case is never exact."""
    expected, got = F.col("expected"), F.col("got")
    answered = F.col("skipped").isNull() & F.col("error").isNull()
    return results.withColumns(
        {
            "exact": answered & same_labels(expected, got),
            "missing": F.array_sort(missing(expected, got)),
            "spurious": F.array_sort(spurious(expected, got)),
        }
    )


def unskipped(results: DataFrame) -> DataFrame:
    """Skipped cases are evidence about nothing; failed ones miss all their labels."""
    return results.filter(F.col("skipped").isNull())


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": f1_score(precision, recall)}


def label_scores(results: DataFrame) -> DataFrame:
    """Per label: support, tp, fp, fn, precision, recall, F1; largest support first."""
    labels = unskipped(results).select(
        "expected", "got", F.explode(F.array_union("expected", "got")).alias("category")
    )
    wanted = F.array_contains("expected", F.col("category"))
    given = F.array_contains("got", F.col("category"))
    counts = labels.groupBy("category").agg(
        F.count_if(wanted & given).alias("tp"),
        F.count_if(~wanted & given).alias("fp"),
        F.count_if(wanted & ~given).alias("fn"),
    )
    scored = counts.withColumn("support", F.col("tp") + F.col("fn")).withColumns(
        _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    )
    return scored.orderBy(F.desc("support"), "category")


def micro_scores(labels: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the summed counts of all labels."""
    sums = labels.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    )
    return sums.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def exact_matches(results: DataFrame) -> DataFrame:
    """One row: scored cases, exact ones and their share, errors, skipped."""
    counted = F.col("skipped").isNull()
    sums = compared(results).agg(
        F.count_if(counted).alias("cases"),
        F.count_if(counted & F.col("exact")).alias("exact"),
        F.count_if(counted & F.col("error").isNotNull()).alias("errors"),
        F.count_if(~counted).alias("skipped"),
    )
    return sums.withColumn("exact_rate", ratio(F.col("exact"), F.col("cases")))


def flag_scores(results: DataFrame) -> DataFrame:
    """One row of flag scores over rows that have both a label and a prediction."""
    wanted, given = F.col("expected_suspicious"), F.col("suspicious")
    labelled = results.filter(wanted.isNotNull() & given.isNotNull())
    sums = labelled.agg(
        F.count("*").alias("labelled"),
        F.count_if(wanted & given).alias("tp"),
        F.count_if(~wanted & given).alias("fp"),
        F.count_if(wanted & ~given).alias("fn"),
        F.count_if(~wanted & ~given).alias("tn"),
    )
    return sums.withColumns(
        {
            **_scores(F.col("tp"), F.col("fp"), F.col("fn")),
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("labelled")),
        }
    )


def flag_mismatches(results: DataFrame) -> DataFrame:
    return results.filter(F.col("expected_suspicious") != F.col("suspicious"))


def mismatches(results: DataFrame) -> DataFrame:
    return compared(unskipped(results)).filter(~F.col("exact"))


def subset_summary(compared_results: DataFrame, *by: str) -> DataFrame:
    """Cases, exact-match rate and micro F1 of each subset (columns of ``compared``).

    Counts entries as they stand in the lists, so a repeated label counts again.
    """
    sums = compared_results.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if("exact").alias("exact"),
        F.coalesce(F.sum(F.size(hits(F.col("expected"), F.col("got")))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size("spurious")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size("missing")), F.lit(0)).alias("fn"),
    )
    scores = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(
        *by,
        "cases",
        ratio(F.col("exact"), F.col("cases")).alias("exact_rate"),
        scores["f1"].alias("micro_f1"),
    )


def pairs(results: DataFrame) -> DataFrame:
    """Every image case that names a text case, with both sides and ``paired``.

    A pair counts only when both sides ran; many images may name one text case, so
    that side is looked up with hot keys spread.
    """
    sides = ["exact", "expected", "got", "missing", "spurious"]
    scored = compared(results)
    images = scored.filter((F.col("source") == IMAGE) & F.col("same_as").isNotNull()).select(
        "id", F.col("same_as").alias("text_id"), F.col("skipped").alias("image_skipped"),
        F.struct(*sides).alias("photo"),
    )
    clean = unskipped(scored).select(F.col("id").alias("text_id"), F.struct(*sides).alias("text"))
    looked_up = salted_lookup(images, clean, ["text_id"], "id")
    both = F.col("image_skipped").isNull() & F.col("text").isNotNull()
    return looked_up.select("id", "text_id", both.alias("paired"), "photo", "text")


def pair_scores(paired: DataFrame) -> DataFrame:
    """Two rows, one per side of the complete pairs: cases, exact rate, micro F1."""
    side = lambda name: F.struct(F.lit(name).alias("side"), f"{name}.*")
    complete = paired.filter("paired").select(
        F.explode(F.array(side("photo"), side("text"))).alias("row")
    )
    return subset_summary(complete.select("row.*"), "side")


def pair_delta(scores: DataFrame) -> DataFrame:
    """What photographs cost: photo minus text, in exact rate and micro F1.

    ``pairs`` is the number of complete pairs; with none both differences are zero.
    """

    def of(name: str, side: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(name))), F.lit(0.0))

    return scores.agg(
        (of("exact_rate", "photo") - of("exact_rate", "text")).alias("exact_delta"),
        (of("micro_f1", "photo") - of("micro_f1", "text")).alias("f1_delta"),
        F.coalesce(F.max("cases"), F.lit(0)).alias("pairs"),
    )
