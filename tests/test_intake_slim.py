"""What the verdicts need of other receipts is stored in a few columns; whole receipts are stored twice, not three times."""

import os

from ledgerloom.plans.intake import take_in
from tests.test_intake import extraction_json
from tests.test_intake_whole import batch, rates


def test_only_repeated_keys_are_looked_up_and_receipts_keep_their_copies(spark, tmp_path):
    root = str(tmp_path)
    rows = batch(
        spark,
        ("a", 5, extraction_json(), "end_turn", None), ("b", 6, extraction_json(), "end_turn", None),
        ("c", 7, extraction_json(total_amount=9), "end_turn", None), ("d", 8, "{broken", "end_turn", None),
    )
    take_in(rows.drop("calls"), rates(spark), root, 0)
    take_in(batch(spark, ("e", 9, extraction_json(total_amount=9), "end_turn", None)).drop("calls"), rates(spark), root, 1)
    assert not os.path.exists(f"{root}/fresh")
    firsts = spark.read.parquet(f"{root}/first_copies").orderBy("batch").collect()
    assert [(r.batch, r.match_id) for r in firsts] == [(0, "a"), (1, "c")]
    assert spark.read.parquet(f"{root}/outliers").count() == 0
    stored = {r.id: r for r in spark.read.parquet(f"{root}/receipts").collect()}
    assert {i: r.duplicate_of for i, r in stored.items()} == {"a": None, "b": "a", "c": None, "d": None, "e": "c"}
    assert stored["a"].raw_response == extraction_json() and stored["d"].raw_response is None
