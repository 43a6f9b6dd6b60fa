"""The evaluation report as ordered lines.

A report names every mismatch, so its length follows the data. It is therefore a
DataFrame of lines with a sort key, written by many tasks, and never one string. A
long list (incomplete pairs) becomes one line per entry for the same reason.

Cases are listed by their ``position`` in the file of cases where the results have one, else by id. Optional columns of
results: ``evidence``; of flags: ``input``, ``flag_reason``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import pad, percent_text, points_text
from ..operators import scoring
from ..sources.sinks import written

# Column widths, rules and sentences of the report.
LABEL_WIDTH, SUPPORT_WIDTH, SCORE_WIDTH = 24, 9, 7
SIDE_WIDTH, PAIR_WIDTH, ID_WIDTH, SOURCE_WIDTH = 18, 15, 30, 9
WIDE_RULE, NARROW_RULE = "-" * 72, "-" * 48
CATEGORY_TITLE = "=== Category classification"
PAIR_TITLE, FLAG_TITLE = "=== Photo vs text ===", "=== Anomaly flag ==="
EXACT_LINE = "Exact set match: %s (%d/%d)   Errors: %d   Skipped: %d"
SKIPPED_LINE = "Skipped (%d), scored as nothing either way:"
PAIRED_LINE = "  %d paired receipts, same expectations on both sides"
NO_PAIRS = '  no complete pairs (an image case needs a "same_as" text case, and both have to run)'
HALF_PAIRS, ONLY_HALF_PAIRS = "  excluded, only one side ran:", "  incomplete pairs:"
FLAG_LINE = "  labelled: %d   P %s   R %s   F1 %s   accuracy %s   tp/fp/fn/tn %d/%d/%d/%d"
NO_LABELS = "  no labelled cases (add expected_suspicious to a case to score it)"
FLAG_MISMATCHES, MISMATCHES = "  Flag mismatches (%d):", "Mismatches (%d):"


def _lines(rows: DataFrame, section: int, key: Column, *texts: Column) -> DataFrame:
    """Several lines per row; a null text is no line. Order: section, key, line number."""
    numbered = F.posexplode(F.array(*[t.cast("string") for t in texts]))
    keyed = rows.select(F.lit(section).alias("section"), key.cast("string").alias("key"), numbered)
    return keyed.select("section", "key", F.col("pos").alias("line_no"), F.col("col").alias("line")).filter(
        F.col("line").isNotNull()
    )


def _score_cells() -> Column:
    return F.concat(*[pad(percent_text(F.col(c)), SCORE_WIDTH) for c in ("precision", "recall", "f1")])


def _listed(name: str) -> Column:
    return F.when(F.size(name) > 0, F.array_join(name, ", "))


def _when_any(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)


def _case_key(rows: DataFrame) -> Column:
    """Cases in file order: padded so that text order is the order of positions."""
    if "position" not in rows.columns:
        return F.col("id")
    return F.concat(F.lpad(F.col("position").cast("string"), 20, "0"), F.lit(" "), F.col("id").cast("string"))


def _optional(rows: DataFrame, name: str) -> Column:
    """A column of text, blank as missing; null where the rows lack it."""
    given = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
    return F.when(given != "", given)


def category_section(results: DataFrame, title: str) -> list[DataFrame]:
    labels = scoring.label_scores(results)
    cells = F.concat(
        pad(F.col("category"), LABEL_WIDTH),
        pad(F.col("support").cast("string"), SUPPORT_WIDTH),
        _score_cells(),
        F.concat_ws("/", "tp", "fp", "fn"),
    )
    head = "".join(
        [
            "category".ljust(LABEL_WIDTH), "support".ljust(SUPPORT_WIDTH),
            "P".ljust(SCORE_WIDTH), "R".ljust(SCORE_WIDTH), "F1".ljust(SCORE_WIDTH), "tp/fp/fn",
        ]
    )
    micro = scoring.micro_scores(labels)
    matches = scoring.exact_matches(results)
    average = F.concat(F.lit("MICRO AVG".ljust(LABEL_WIDTH + SUPPORT_WIDTH)), _score_cells())
    exact = F.format_string(
        EXACT_LINE,
        percent_text(F.col("exact_rate")), "exact", "cases", "errors", "skipped",
    )
    by_support = F.concat(F.lpad((F.lit(10**18) - F.col("support")).cast("string"), 20, "0"), "category")
    none = F.lit("")
    return [
        _lines(micro, 10, none, F.lit(title), none, F.lit(head), F.lit(WIDE_RULE)),
        _lines(labels, 11, by_support, cells),
        _lines(micro, 12, none, F.lit(WIDE_RULE), average, none),
        _lines(matches, 13, none, exact),
    ]


def skipped_section(results: DataFrame) -> list[DataFrame]:
    skipped = results.filter(F.col("skipped").isNotNull())
    count = skipped.agg(F.count("*").alias("n")).filter("n > 0")
    heading = F.format_string(SKIPPED_LINE, "n")
    line = F.concat(F.lit("  "), pad(F.col("id").cast("string"), ID_WIDTH), F.lit(" "), F.col("skipped"))
    return [
        _lines(count, 20, F.lit(""), F.lit(""), heading),
        _lines(skipped, 21, _case_key(skipped), line),
    ]


def pair_section(results: DataFrame) -> list[DataFrame]:
    paired = scoring.pairs(results)
    if "position" in results.columns:
        paired = paired.join(results.select("id", "position"), "id")
    sides = scoring.pair_scores(paired)
    counts = paired.agg(F.count_if("paired").alias("complete"), F.count_if(~F.col("paired")).alias("half"))
    some = F.col("complete") > 0
    shown = F.format_string(PAIRED_LINE, "complete")
    nothing = F.lit(NO_PAIRS)
    head = F.lit("".ljust(SIDE_WIDTH) + "exact match".ljust(PAIR_WIDTH) + "micro F1".ljust(PAIR_WIDTH))
    rule = F.lit(NARROW_RULE)
    cells = F.concat(
        pad(F.when(F.col("side") == "text", "clean text").otherwise("photograph"), SIDE_WIDTH),
        pad(percent_text(F.col("exact_rate")), PAIR_WIDTH),
        pad(percent_text(F.col("micro_f1")), PAIR_WIDTH),
    )
    delta = F.concat(
        F.lit("delta".ljust(SIDE_WIDTH)),
        pad(points_text(F.col("exact_delta")), PAIR_WIDTH),
        pad(points_text(F.col("f1_delta")), PAIR_WIDTH),
    )
    half = F.when(F.col("half") > 0, F.when(some, HALF_PAIRS).otherwise(ONLY_HALF_PAIRS))
    gap = F.when((F.col("half") > 0) & some, F.lit(""))
    only = lambda text: F.when(some, text)
    with_pairs = scoring.pair_delta(sides).filter("pairs > 0")
    return [
        _lines(
            counts, 30, F.lit(""), F.lit(""), F.lit(PAIR_TITLE), F.lit(""),
            F.when(some, shown).otherwise(nothing), only(F.lit("")), only(head), only(rule),
        ),
        _lines(sides, 31, F.when(F.col("side") == "text", "0").otherwise("1"), cells),
        _lines(with_pairs, 32, F.lit(""), rule, delta),
        _lines(counts, 33, F.lit(""), gap, half),
        _lines(paired.filter("not paired"), 34, _case_key(paired), F.concat(F.lit("    "), F.col("id").cast("string"))),
    ]


def flag_section(results: DataFrame) -> list[DataFrame]:
    scores = scoring.flag_scores(results)
    line = F.format_string(
        FLAG_LINE,
        "labelled", percent_text(F.col("precision")), percent_text(F.col("recall")),
        percent_text(F.col("f1")), percent_text(F.col("accuracy")), "tp", "fp", "fn", "tn",
    )
    nothing = F.lit(NO_LABELS)
    wrong = scoring.flag_mismatches(results)
    heading = F.format_string(FLAG_MISMATCHES, "n")
    count = wrong.agg(F.count("*").alias("n")).filter("n > 0")
    both = F.format_string(
        "      expected : %s   got: %s",
        F.col("expected_suspicious").cast("string"), F.col("suspicious").cast("string"),
    )
    shown = F.concat(F.lit("      "), pad(F.col("source"), SOURCE_WIDTH), F.lit(": "), _optional(wrong, "input"))
    return [
        _lines(
            scores, 40, F.lit(""), F.lit(""), F.lit(FLAG_TITLE), F.lit(""),
            F.when(F.col("labelled") == 0, nothing).otherwise(line),
        ),
        _lines(count, 41, F.lit(""), F.lit(""), heading),
        _lines(
            wrong, 42, _case_key(wrong), F.lit(""), F.concat(F.lit("    "), F.col("id").cast("string")), shown, both,
            _when_any("      reason   : ", _optional(wrong, "flag_reason")),
        ),
    ]


def mismatch_section(results: DataFrame) -> list[DataFrame]:
    wrong = scoring.mismatches(results)
    count = wrong.agg(F.count("*").alias("n")).filter("n > 0")
    return [
        _lines(count, 50, F.lit(""), F.lit(""), F.format_string(MISMATCHES, "n")),
        _lines(
            wrong, 51, _case_key(wrong),
            F.lit(""),
            F.concat(F.lit("  "), F.col("id").cast("string")),
            F.concat(F.lit("    "), pad(F.col("source"), SOURCE_WIDTH), F.lit(": "), F.col("input")),
            F.concat(F.lit("    expected : "), F.coalesce(_listed("expected"), F.lit("(none)"))),
            F.concat(F.lit("    got      : "), F.coalesce(_listed("got"), F.lit("(none)"))),
            _when_any("    missing  : ", _listed("missing")),
            _when_any("    spurious : ", _listed("spurious")),
            _when_any("    evidence : ", _optional(wrong, "evidence")),
            _when_any("    error    : ", F.col("error")),
        ),
    ]


def score_report(results: DataFrame, label: str | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Report lines (section, key, line_no, line); order by them to read the report."""
    suffix = f" [{label}]" if label else ""
    parts = [
        *category_section(results, f"{CATEGORY_TITLE}{suffix} ==="),
        *skipped_section(results),
        *pair_section(results),
        *(flag_section(flags) if flags is not None else []),
        *mismatch_section(results),
    ]
    return reduce(DataFrame.unionByName, parts)


def in_reading_order(report: DataFrame) -> DataFrame:
    return report.orderBy("section", "key", "line_no")


def numbered(report: DataFrame) -> DataFrame:
    """Lines with their number in the whole report, from 1 (columns number, line).

    The lines are sorted by range and stored; only one count per sorted part is gathered to shift
    the numbers of the later parts, so no task sees the whole report.
    """
    order = ("section", "key", "line_no")
    sorted_lines = report.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_lines.withColumn("_place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((row.part, total))
        total += row["count"]
    offsets = report.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.select((F.col("_start") + inside + 1).alias("number"), "line")
