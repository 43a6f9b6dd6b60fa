import pytest

from ledgerloom.operators import scoring
from ledgerloom.plans.score_report import in_reading_order, score_report
from ledgerloom.sources import sinks

RESULT = (
    "id string, input string, source string, same_as string, skipped string, error string,"
    " expected array<string>, got array<string>, expected_suspicious boolean, suspicious boolean"
)


def result(id, expected, got, source="text", same_as=None, skipped=None, error=None, want=None, flag=None):
    return (id, f"text of {id}", source, same_as, skipped, error, expected, got, want, flag)


@pytest.fixture
def results(spark):
    rows = [
        result("a", ["Food"], ["Food"], want=True, flag=True),
        result("b", ["Food", "Health"], ["Food", "Other"], want=False, flag=True),
        result("c", ["Leisure"], [], error="boom", want=True),
        result("d", [], [], error="boom"),
        result("e", ["Food", "Food"], ["Food"], want=False, flag=False),
        result("a-photo", ["Food"], ["Health"], "image", "a"),
        result("b-photo", ["Food"], [], "image", "b", skipped="no file"),
        result("z-photo", ["Food"], ["Food"], "image", "nowhere"),
    ]
    return spark.createDataFrame(rows, RESULT)


def test_label_scores(results):
    rows = scoring.label_scores(results).collect()
    assert [(r.category, r.support, r.tp, r.fp, r.fn) for r in rows] == [
        ("Food", 5, 4, 0, 1), ("Health", 1, 0, 1, 1), ("Leisure", 1, 0, 0, 1), ("Other", 0, 0, 1, 0),
    ]
    assert rows[0].precision == 1.0 and rows[0].recall == 0.8
    assert rows[3].f1 == 0.0
    micro = scoring.micro_scores(scoring.label_scores(results)).first()
    assert (micro.tp, micro.fp, micro.fn) == (4, 2, 3)
    assert micro.f1 == pytest.approx(2 * (4 / 6) * (4 / 7) / (4 / 6 + 4 / 7))


def test_exact_matches(results):
    row = scoring.exact_matches(results).first()
    assert (row.cases, row.exact, row.errors, row.skipped) == (7, 2, 2, 1)
    wrong = {r.id: r for r in scoring.mismatches(results).collect()}
    assert set(wrong) == {"b", "c", "d", "e", "a-photo"}
    assert (wrong["b"].missing, wrong["b"].spurious) == (["Health"], ["Other"])


def test_flags(results):
    row = scoring.flag_scores(results).first()
    assert (row.labelled, row.tp, row.fp, row.fn, row.tn) == (3, 1, 1, 0, 1)
    assert (row.precision, row.recall, row.accuracy) == (0.5, 1.0, pytest.approx(2 / 3))


def test_pairs(results):
    paired = scoring.pairs(results)
    assert {r.id: r.paired for r in paired.collect()} == {
        "a-photo": True, "b-photo": False, "z-photo": False,
    }
    sides = {r.side: (r.cases, r.exact_rate, r.micro_f1) for r in scoring.pair_scores(paired).collect()}
    assert sides == {"text": (1, 1.0, 1.0), "photo": (1, 0.0, 0.0)}
    delta = scoring.pair_delta(scoring.pair_scores(paired)).first()
    assert (delta.exact_delta, delta.f1_delta) == (-1.0, -1.0)


def test_published_rates(spark):
    """44 of 48 cases exact, 50 hits, 4 spurious and 3 missing labels."""
    rows = [result(f"x{i}", ["Food"], ["Food"]) for i in range(39)]
    rows += [result(f"y{i}", ["Food", "Health"], ["Food", "Health"]) for i in range(5)]
    rows += [result(f"m{i}", ["Food"], ["Prepared food or drinks"]) for i in range(3)]
    rows += [result("s", ["Food"], ["Food", "Prepared food or drinks"])]
    frame = spark.createDataFrame(rows, RESULT)
    micro = scoring.micro_scores(scoring.label_scores(frame)).first()
    assert (round(micro.precision, 4), round(micro.recall, 4), round(micro.f1, 4)) == (0.9259, 0.9434, 0.9346)
    assert round(scoring.exact_matches(frame).first().exact_rate, 4) == 0.9167


def test_report(spark, results, tmp_path):
    lines = [r.line for r in in_reading_order(score_report(results, "run 1", results)).collect()]
    text = "\n".join(lines)
    assert lines[0] == "=== Category classification [run 1] ==="
    assert "Food                    5        100.0% 80.0%  88.9%  4/0/1" in lines
    assert "Exact set match: 28.6% (2/7)   Errors: 2   Skipped: 1" in lines
    assert lines.index("Skipped (1), scored as nothing either way:") > 0
    assert "  b-photo                        no file" in lines
    assert "  1 paired receipts, same expectations on both sides" in lines
    assert "delta             -100.0pp       -100.0pp       " in lines
    assert "  excluded, only one side ran:" in lines and "    z-photo" in lines
    assert "  labelled: 3   P 50.0%   R 100.0%   F1 66.7%   accuracy 66.7%   tp/fp/fn/tn 1/1/0/1" in lines
    assert "      expected : false   got: true" in lines
    assert "Mismatches (5):" in lines and "    got      : (none)" in lines
    assert text.index("=== Photo vs text ===") < text.index("=== Anomaly flag ===")
    sinks.write_report(score_report(results), str(tmp_path / "report"))
    stored = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "=== Category classification ===" in stored


def test_report_without_pairs_or_labels(spark):
    frame = spark.createDataFrame([result("a", ["Food"], ["Food"])], RESULT)
    lines = [r.line for r in in_reading_order(score_report(frame, None, frame)).collect()]
    assert any(line.startswith("  no complete pairs") for line in lines)
    assert any(line.startswith("  no labelled cases") for line in lines)
    assert not any(line.startswith("Mismatches") for line in lines)


def test_cases_stand_in_file_order_with_all_their_lines(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans.score_report import numbered

    rows = [result("t", ["Food"], ["Health"]), result("a", ["Food"], []), result("z", ["Food"], ["Food"])]
    frame = spark.createDataFrame(rows, RESULT).withColumns({
        "position": F.when(F.col("id") == "t", 2).when(F.col("id") == "a", 10).otherwise(1),
        "evidence": F.when(F.col("id") == "t", "line 3").when(F.col("id") == "a", ""),
    })
    flags = spark.createDataFrame(
        [("f", "text", 1, "some text", True, False, "Odd."), ("g", "text", 2, None, False, True, None)],
        "id string, source string, position int, input string, expected_suspicious boolean, suspicious boolean, flag_reason string",
    )
    report = score_report(frame, None, flags)
    lines = [r.line for r in in_reading_order(report).collect()]
    assert lines.index("  t") < lines.index("  a")
    assert [line for line in lines if line.startswith("    evidence")] == ["    evidence : line 3"]
    assert lines[lines.index("    f") + 1 :][:3] == ["      text     : some text", "      expected : true   got: false", "      reason   : Odd."]
    got = sorted((r.number, r.line) for r in numbered(report).collect())
    assert [n for n, _ in got] == list(range(1, len(lines) + 1)) and [line for _, line in got] == lines


def test_a_blank_line_before_excluded_pairs(spark, results):
    lines = [r.line for r in in_reading_order(score_report(results)).collect()]
    assert lines[lines.index("  excluded, only one side ran:") - 1] == ""
