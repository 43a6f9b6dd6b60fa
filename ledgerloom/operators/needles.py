"""Many needles in many texts: an inverted index of short substrings (grams) over the distinct texts.

A needle meets the texts that hold its rarest gram, by equality, and only those are searched. A text that
lacks a gram of the needle cannot hold the needle, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import written

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """The distinct substrings of so many characters; none for a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def posting_lists(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, text, folded) for the grams that some needle has."""
    folded = texts.select("text").filter("text is not null").distinct().withColumn("folded", F.lower("text"))
    every = F.flatten(F.array(*[grams(F.col("folded"), F.lit(size)) for size in range(1, GRAM + 1)]))
    postings = folded.select("text", "folded", F.explode(every).alias("gram"))
    return postings.join(asked.select("gram").distinct(), "gram", "left_semi")


def candidates(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text, folded): the texts that hold the needle's rarest gram."""
    folded = F.lower("needle")
    named = needles.select("needle").filter(F.length(folded) > 0).distinct()
    asked = named.select("needle", F.explode(grams(folded, F.least(F.length(folded), F.lit(GRAM)))).alias("gram"))
    postings = written(posting_lists(texts, asked))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("texts"))
    counted = asked.join(sizes, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = counted.groupBy("needle").agg(F.min(F.struct("texts", "gram")).alias("rarest"))
    # A gram that no text has rules its needle out.
    able = rarest.filter("rarest.texts > 0").select("needle", "rarest.gram")
    return able.join(postings, "gram").select("needle", "text", "folded")


def holders(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) for every distinct text that holds the needle, whatever the case of either.

    ``needles`` has a column ``needle``, ``texts`` a column ``text``. Null or empty needles have no row, a null text holds nothing.
    """
    found = candidates(needles, texts)
    return found.filter(F.contains("folded", F.lower("needle"))).select("needle", "text")
