import datetime as dt
import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import insights, requests as R
from ledgerloom.schemas import TAXONOMY

BASE = {
    "from": "2026-06-01", "to": "2026-08-31", "categories": None, "merchant": None,
    "min_total": None, "max_total": None,
}
SHAPE = "spec_id bigint, input string"


def parse(spark, *inputs):
    texts = [i if isinstance(i, str) else json.dumps(i) for i in inputs]
    rows = spark.createDataFrame(list(enumerate(texts)), SHAPE)
    return R.parse_requests(rows).orderBy("spec_id").collect()


def test_accepts_and_trims(spark):
    row, blank = parse(
        spark,
        {**BASE, "categories": ["Food"], "merchant": "  Corner Shop \t", "min_total": 5},
        {"from": "2026-06-01", "to": "2026-08-31", "categories": [], "merchant": "   "},
    )
    assert row.error is None and row.from_day == dt.date(2026, 6, 1)
    assert (row.wanted, row.needle, row.min_total) == (["Food"], "Corner Shop", 5)
    assert row.max_total is None
    assert (blank.error, blank.wanted, blank.needle, blank.min_total) == (None, None, None, None)


@pytest.mark.parametrize(
    "given, error",
    [
        ('"from 2026-06-01"', R.NOT_AN_OBJECT),
        ("[]", R.NOT_AN_OBJECT),
        ("null", R.NOT_AN_OBJECT),
        ("{broken", R.NOT_AN_OBJECT),
        ({**BASE, "sql": "x"}, "Unknown argument(s): sql."),
        ({**BASE, "b": 1, "a": 2}, "Unknown argument(s): b, a."),
        ({**BASE, "from": "01/06/2026"}, R.NOT_REAL_DAYS),
        ({**BASE, "to": "2026-02-30"}, R.NOT_REAL_DAYS),
        ({**BASE, "to": None}, R.NOT_REAL_DAYS),
        ({**BASE, "from": 20260601}, R.NOT_REAL_DAYS),
        ({"to": "2026-02-01"}, R.NOT_REAL_DAYS),
        ({**BASE, "from": "2026-09-01"}, R.REVERSED),
        ({**BASE, "categories": ["Dinners"]}, R.BAD_CATEGORIES),
        ({**BASE, "categories": [None]}, R.BAD_CATEGORIES),
        ({**BASE, "categories": "Food"}, R.BAD_CATEGORIES),
        ({**BASE, "merchant": 42}, R.BAD_MERCHANT),
        ({**BASE, "merchant": "x" * 101}, R.LONG_MERCHANT),
        ({**BASE, "min_total": -1}, R.BAD_AMOUNTS),
        ({**BASE, "max_total": "5"}, R.BAD_AMOUNTS),
        ({**BASE, "max_total": True}, R.BAD_AMOUNTS),
        ('{"from":"2026-06-01","to":"2026-06-02","max_total":1e999}', R.BAD_AMOUNTS),
        ({**BASE, "min_total": 50, "max_total": 10}, R.MIN_ABOVE_MAX),
    ],
)
def test_rejections(spark, given, error):
    (row,) = parse(spark, given)
    assert row.error == error
    assert (row.from_day, row.wanted, row.needle, row.max_total) == (None, None, None, None)


def test_longest_allowed_merchant(spark):
    (row,) = parse(spark, {**BASE, "merchant": " " + "x" * 100 + " "})
    assert row.error is None and row.needle == "x" * 100


RECEIPTS = [
    # id, merchant, date, total, eur, currency, status, categories
    (1, "Corner 100% Shop", "2026-06-01", "10.00", "10.00", "EUR", "completed", ["Food", "Health"]),
    (2, "CORNER shop", "2026-08-31", "20.00", None, "USD", "completed", ["Food"]),
    (3, "Other", "2026-07-15", "30.00", "25.00", "USD", "completed", []),
    (4, "Corner shop", "2026-07-15", "40.00", "40.00", None, "completed", ["Leisure"]),
    (5, "Corner shop", "2026-07-15", "50.00", "50.00", "EUR", "failed", ["Food"]),
    (6, "Corner shop", "2026-07-15", None, None, "EUR", "completed", ["Food"]),
    (7, "Corner shop", None, "60.00", "60.00", "EUR", "completed", ["Food"]),
    (8, None, "2026-07-31", "70.00", "70.00", "EUR", "completed", ["Food"]),
]


def frames(spark):
    rows = [(i, m, d and dt.date.fromisoformat(d), t and Decimal(t), e and Decimal(e), c, s)
            for i, m, d, t, e, c, s, _ in RECEIPTS]
    receipts = spark.createDataFrame(
        rows, "id bigint, merchant string, receipt_date date, total_amount decimal(12,2),"
        " total_eur decimal(12,2), currency string, status string"
    )
    pairs = [(r[0], name) for r in RECEIPTS for name in r[7]]
    return receipts, spark.createDataFrame(pairs, "receipt_id bigint, category string")


REQUESTS = [
    BASE,
    {**BASE, "categories": ["Food", "Health"]},
    {**BASE, "merchant": "corner"},
    {**BASE, "merchant": "100% s"},
    {**BASE, "min_total": 20, "max_total": 30},
    {**BASE, "from": "2027-01-01", "to": "2027-01-02"},
    {**BASE, "merchant": 1},
]


def totals(*pairs):
    return [tuple(p) for p in pairs]


EXPECTED = {
    0: [("EUR", 2, 80, 80, 0), ("USD", 2, 50, 25, 1), (None, 1, 40, 40, 0)],
    1: [("EUR", 2, 80, 80, 0), ("USD", 1, 20, 0, 1)],
    2: [("EUR", 1, 10, 10, 0), ("USD", 1, 20, 0, 1), (None, 1, 40, 40, 0)],
    3: [("EUR", 1, 10, 10, 0)],
    4: [("USD", 2, 50, 25, 1)],
    5: [],
    6: None,
}


@pytest.mark.parametrize("most", [R.MAX_BROADCAST_BLOCKS, 0])
def test_answers_with_broadcast_and_shuffled_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MAX_BROADCAST_BLOCKS", most)
    asked = spark.createDataFrame(
        [(i, json.dumps(r)) for i, r in enumerate(REQUESTS)], SHAPE
    )
    rows = R.answer_requests(asked, *frames(spark)).collect()
    got = {r.spec_id: None if r.result is None else [tuple(x) for x in r.result] for r in rows}
    assert got == EXPECTED
    assert {r.spec_id for r in rows if r.error} == {6}


def test_categories_match_the_fixed_list():
    assert len(TAXONOMY) == len(set(TAXONOMY)) == 15


def test_a_request_for_all_time_has_no_more_rows_than_the_data_has_months(spark):
    days = spark.sql("select date'2026-01-15' as receipt_date union all select date'2026-04-02'")
    asked = spark.sql("select 1 as spec_id, date'0001-01-01' as from_day, date'9999-12-31' as to_day union all "
                      "select 2, date'2027-01-01', date'2027-02-01'")
    rows = insights.within_span(asked, "from_day", "to_day", days).collect()
    assert sorted((r.spec_id, str(r.month)) for r in rows) == [(1, f"2026-0{m}-01") for m in (1, 2, 3, 4)]
    assert insights.within_span(asked, "from_day", "to_day", days.limit(0)).count() == 0


def brute_answer(request, receipts):
    if set(request) - set(R.KEYS):
        return None
    out = {}
    for _, merchant, day, total, eur, currency, status, names in receipts:
        if status != "completed" or total is None or day is None or not request["from"] <= day <= request["to"]:
            continue
        if request["categories"] and not set(request["categories"]) & set(names):
            continue
        if request["merchant"] and (merchant is None or request["merchant"].strip().lower() not in merchant.lower()):
            continue
        low, high = request["min_total"], request["max_total"]
        if (low is not None and float(total) < low) or (high is not None and float(total) > high):
            continue
        line = out.setdefault(currency, [0, Decimal(0), Decimal(0), 0])
        line[0] += 1
        line[1] += Decimal(total)
        line[2] += Decimal(eur or 0)
        line[3] += eur is None
    return sorted(((c, *v) for c, v in out.items()), key=lambda r: (r[0] is None, r[0] or ""))


def many(seed, count, asked):
    rng = random.Random(seed)
    day = lambda: str(dt.date(2025, 1, 1) + dt.timedelta(days=rng.choice([0, 31, rng.randrange(900)])))
    names = ["Food", "Health", "Leisure", "Other"]
    cents = lambda: rng.choice([0, 1, 999_999, 1_000_000, 1_000_001, rng.randrange(-500, 3_000_000)])
    receipts = []
    for i in range(count):
        total = None if rng.random() < 0.05 else f"{Decimal(cents()) / 100}"
        receipts.append((
            i, rng.choice(["Corner Shop", "corner kiosk", "Ä Bakery", None, "Hall 9"]), None if rng.random() < 0.05 else day(),
            total, None if total is None or rng.random() < 0.2 else total, rng.choice(["EUR", "USD", None]),
            "completed" if rng.random() < 0.9 else "failed", rng.sample(names, rng.randrange(3)),
        ))
    requests = []
    for _ in range(asked):
        first, last = sorted((day(), day()))
        limits = sorted(rng.choice([None, 0, 0.01, 9_999.99, 10_000.0, 10_000.005, rng.randrange(40_000), 1e300]) or 0 for _ in range(2))
        requests.append({
            "from": first, "to": rng.choice([last, last, "9999-12-31"]),
            "categories": rng.choice([None, rng.sample(names, rng.randrange(1, 4))]),
            "merchant": rng.choice([None, None, "corner", "ORNER S", "ä", "k", "none such"]),
            "min_total": rng.choice([None, limits[0]]), "max_total": rng.choice([None, limits[1]]),
        })
    return receipts, requests


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_equal_brute_force(spark, monkeypatch, seed):
    receipts, asked = many(seed, 400, 150)
    rows = [(i, m, d and dt.date.fromisoformat(d), t and Decimal(t), e and Decimal(e), c, s) for i, m, d, t, e, c, s, _ in receipts]
    frame = spark.createDataFrame(
        rows, "id bigint, merchant string, receipt_date date, total_amount decimal(12,2), total_eur decimal(12,2), currency string, status string"
    )
    bridge = spark.createDataFrame([(r[0], name) for r in receipts for name in r[7]], "receipt_id bigint, category string")
    inputs = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(asked)], SHAPE)
    for r in R.answer_requests(inputs, frame, bridge).collect():
        assert [tuple(x) for x in r.result] == brute_answer(asked[r.spec_id], receipts), asked[r.spec_id]


def test_a_request_meets_few_sums_however_long_it_is(spark):
    asked = [{**BASE, "from": "0001-01-01", "to": "9999-12-31"}, {**BASE, "from": "2000-01-01", "to": "2029-12-31"}, BASE]
    parsed = R.parse_requests(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(asked)], SHAPE))
    sizes = {r.spec_id: r["count"] for r in R.asked_blocks(parsed).groupBy("spec_id").count().collect()}
    assert sizes[0] <= 44 and sizes[1] <= 28 and sizes[2] <= 14


def test_no_request_is_compared_with_receipts(spark):
    receipts, asked = many(3, 50, 40)
    frame, bridge = frames(spark)
    inputs = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(asked)], SHAPE)
    plan = R.answer_requests(inputs, frame, bridge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_requests_for_many_merchants_share_their_sums(spark, monkeypatch):
    """A request meets a few sums of its needle, not some of every merchant that holds it."""
    met, keyed = [], R._keyed
    monkeypatch.setattr(R, "_keyed", lambda *given: met.append(keyed(*given)) or met[-1])
    day = dt.date(2026, 6, 5)
    rows = [(i, f"Shop {i}", day, Decimal("5.00"), Decimal("5.00"), "EUR", "completed") for i in range(300)]
    receipts = spark.createDataFrame(rows, frames(spark)[0].schema)
    bridge = spark.createDataFrame([(i, "Food") for i in range(0, 300, 3)], "receipt_id bigint, category string")
    given = [{**BASE, "merchant": "shop", "min_total": 1}, {**BASE, "merchant": "SHOP"}, {**BASE, "merchant": "shop", "categories": ["Food"]}]
    inputs = spark.createDataFrame([(i, json.dumps(given[i % 3])) for i in range(30)], SHAPE)
    results = {r.spec_id: r.result[0].receipts for r in R.answer_requests(inputs, receipts, bridge).collect()}
    assert results == {i: 100 if i % 3 == 2 else 300 for i in range(30)}
    assert met[0].count() <= 30 * 14


def test_refused_requests_alone_have_no_result(spark):
    inputs = spark.createDataFrame([(1, "{}"), (2, "x")], SHAPE)
    assert all(r.error and r.result is None for r in R.answer_requests(inputs, *frames(spark)).collect())
