"""Deletion of repeated runs of lines by winnowing.

Lines are compared trimmed of ASCII white space; blank lines are no lines here and always stay. In
every window of ``RUN`` consecutive lines the line with the smallest hash (the last of equal ones) is the
window's fingerprint. Equal windows have equal fingerprints at the same place, so a run of ``RUN`` or more lines
that two documents share has a fingerprint in common. Positions are joined by fingerprint; around a
fingerprint that is met more than once the match is extended both ways by comparing all windows
that it stands for, and the windows on to either side have fingerprints of their own, so a match grows as far
as the lines agree. A window that has occurred before is a repeat: its lines are deleted. Before means: in
a smaller key, or further up in the same document; the very first occurrence stays. Runs are judged on the
input, not on what is left, and may overlap.

With ``long_words``, a window is also one line that alone has so many words. Its fingerprint is its own hash, apart
from those of runs, so a long repeated line goes wherever it stands, while a short one needs a neighbour.

Only DataFrame functions: windows are cut inside each row, and what is shuffled is one narrow row
per window. A fingerprint or window that very many documents share is counted before the shuffle and met
by a bounded broadcast.

Defined cases: a null text stays null, an empty one empty; a null key comes after all others; rows that
repeat a key are ordered by a hash of their text, and rows that repeat key and text are one document, kept as
often as they occur; an empty table gives an empty result; other columns pass through, but for those named as the counts that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_SPACES, with_group, written

RUN = 2
COUNTS = ("n_lines", "n_removed")


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def _n_words(line: Column, least: int) -> Column:
    """Words of a trimmed line, zero where its length rules out so many as ``least``."""
    return F.when(F.length(line) >= 2 * least - 1, F.size(F.split(line, ASCII_SPACES))).otherwise(0)


def _windows(documents: DataFrame, key: str, text: str, run: int, long_words: int | None = None) -> DataFrame:
    """One row per window: document, place, the numbers of its lines, fingerprint, hash of all its lines."""
    is_long = (lambda line: [(_n_words(line, long_words) >= long_words).alias("long")]) if long_words else (lambda line: [])
    numbered = F.transform(
        _trimmed_lines(F.col(text)),
        lambda line, at: F.struct(F.length(line).alias("n"), F.xxhash64(line).alias("hash"), at.alias("at"), *is_long(line)),
    )
    lines = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.filter(numbered, lambda line: line["n"] > 0).alias("lines")
    )
    count = F.size("lines") - run + 1
    shifted = [F.slice("lines", i + 1, F.greatest(count, F.lit(0))).alias(f"l{i}") for i in range(run)]
    together = F.arrays_zip(*shifted)

    def window(of: Column, place: Column) -> Column:
        parts = [of[f"l{i}"] for i in range(run)]
        low = F.array_min(F.array(*[p["hash"] for p in parts]))
        inside = F.lit(0)
        for i, part in enumerate(parts):
            inside = F.when(part["hash"] == low, i).otherwise(inside)
        return F.struct(
            place.alias("place"),
            F.array(*[p["at"] for p in parts]).alias("ats"),
            low.alias("low"),
            (place + inside).alias("low_at"),
            F.xxhash64(*[p["hash"] for p in parts]).alias("window"),
        )

    cut = F.transform(together, window)
    # Neighbouring windows often choose the same line; it is one fingerprint.
    fresh = F.transform(cut, lambda w, i: F.struct(w["place"], w["ats"], w["low"], w["window"], ((i == 0) | (F.get(cut, i - 1)["low_at"] != w["low_at"])).alias("fresh")))
    if long_words:
        def alone(line: Column, place: Column) -> Column:
            own = F.xxhash64(F.lit("one line"), line["hash"])
            window = F.struct(
                place.alias("place"), F.array(line["at"]).alias("ats"), own.alias("low"), own.alias("window"), F.lit(True).alias("fresh")
            )
            return F.when(line["long"], window)

        fresh = F.concat(fresh, F.filter(F.transform("lines", alone), lambda w: w.isNotNull()))
    return lines.select("key", "mark", F.explode(fresh).alias("w")).select("key", "mark", "w.*")


def repeated_windows(documents: DataFrame, key: str, text: str, run: int, long_words: int | None = None) -> DataFrame:
    """(key, mark, ats): every window that has occurred before."""
    windows = written(_windows(documents, key, text, run, long_words))
    met = windows.groupBy("low").agg(
        F.count_if("fresh").alias("fingerprints"), F.count("*").alias("size")
    )
    candidates = written(with_group(windows, written(met.where("fingerprints > 1")), "low").drop("low", "fresh", "fingerprints", "size"))
    occurrence = F.struct(F.col("key").isNull().alias("last"), "key", "mark", "place")
    firsts = candidates.groupBy("window").agg(F.min(occurrence).alias("first"), F.count("*").alias("size"))
    later = with_group(candidates, written(firsts.where("size > 1")), "window")
    return later.where(occurrence > F.col("first")).select("key", "mark", "ats")


def without_repeated_lines(
    documents: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long_words: int | None = None
) -> DataFrame:
    """The documents with their columns, ``text`` without its repeated lines, and after these columns
    ``n_lines`` (lines that are not blank) and ``n_removed``."""
    repeats = repeated_windows(documents, key, text, run, long_words)
    deleted = repeats.groupBy("key", "mark").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("_deleted"))
    found = deleted.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), "_deleted")
    same = documents[key].eqNullSafe(found["_key"]) & (F.xxhash64(documents[text]) == found["_mark"])
    # Whole texts move once, and only towards the few columns of their deletions.
    joined = documents.join(found, same, "left")
    lines = F.split(documents[text], "\n")
    gone = found["_deleted"]
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), documents[text]).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    solid = F.size(F.filter(_trimmed_lines(documents[text]), lambda line: line != ""))
    return joined.select(
        *[kept.alias(text) if c == text else documents[c] for c in documents.columns if c not in COUNTS],
        F.when(documents[text].isNull(), 0).otherwise(solid).cast("bigint").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("n_removed"),
    )
