"""Text expressions: trimming, report wording, joined reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space removed from the ends of free text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(text: Column) -> Column:
    """Remove every kind of white space from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def has_text(text: Column) -> Column:
    """True when something other than white space is left; null counts as no text."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def merchant_key(merchant: Column) -> Column:
    """The merchant as duplicates compare it: outer spaces only, case folded."""
    return F.lower(F.trim(merchant))


def with_final_stop(sentence: Column) -> Column:
    ends = F.right(sentence, F.lit(1)).isin(".", "!", "?")
    return F.when(ends, sentence).otherwise(F.concat(sentence, F.lit(".")))


def join_reasons(base: Column, *reasons: Column) -> Column:
    """One sentence list from the base reason and the reasons that fired.

    Null or blank reasons did not fire. With none fired the base is returned
    exactly as it came, without trimming or a final stop.
    """
    shown = [F.when(has_text(r), with_final_stop(strip(r))) for r in reasons]
    fired = F.coalesce(*shown).isNotNull()
    lead = F.when(has_text(base), with_final_stop(strip(base)))
    return F.when(fired, F.concat_ws(" ", lead, *shown)).otherwise(base)


def any_reason(*reasons: Column) -> Column:
    fired = F.lit(False)
    for reason in reasons:
        fired = fired | has_text(reason)
    return fired


def plural(count: Column, noun: str) -> Column:
    return F.concat(
        count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s")
    )


def two_decimals(amount: Column) -> Column:
    """A decimal amount with exactly two digits after the point."""
    return amount.cast("decimal(38,2)").cast("string")


def money_text(amount: Column, currency: Column) -> Column:
    """``12.30 EUR``, or ``12.30`` when no currency is known."""
    known = F.coalesce(F.length(currency) > 0, F.lit(False))
    return F.when(known, F.concat_ws(" ", two_decimals(amount), currency)).otherwise(
        two_decimals(amount)
    )


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def points_text(difference: Column) -> Column:
    """A signed difference of two shares, in percentage points."""
    return F.format_string("%+.1fpp", difference * 100)


def pad(text: Column, width: int) -> Column:
    """Pad on the right; longer text is kept whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def contains_ignoring_case(text: Column, needle: Column) -> Column:
    """Literal containment: no character of the needle is a wildcard."""
    return F.contains(F.lower(text), F.lower(needle))


def escape_wildcards(needle: Column) -> Column:
    """The needle as an ILIKE pattern part, for callers that write SQL patterns."""
    return F.regexp_replace(needle, r"([\\%_])", r"\\$1")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")
