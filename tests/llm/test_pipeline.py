"""The registered queries next to their SQL, and every stage of the pipeline."""

import os
import re
import zlib

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from check_queries import compare, open_tables
from ledgerloom.llm import pieces
from ledgerloom.llm.common import written
from ledgerloom.llm.queries import CHECKS, QUERIES

from .rows import DOCUMENTS, LONG, MESSY, documents, empty
from .test_text import MODEL, brute_words

FOLDER = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are absent")
NATIVE = ("op4_exact_dedup", "op6_url_filter", "op8_line_dedup")


@supplied
@pytest.mark.parametrize("name", list(CHECKS))
def test_same_rows_as_sql(spark, name):
    same, note = compare(spark, open_tables(FOLDER), FOLDER, name)
    assert same, note


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registry.queries())


@supplied
@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


def source_of(module):
    return open(module.__file__, encoding="utf-8").read()


def test_native_operators_use_dataframe_functions_only():
    from ledgerloom.llm import exact_dedup, line_dedup, url_filter

    for module in (exact_dedup, line_dedup, url_filter):
        assert not re.search(r"pandas|pyarrow|mapIn|applyIn|udf|\.rdd", source_of(module))


@supplied
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in CHECKS])
def test_one_row_per_document_or_page(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    table, key = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in rows.select(key).collect()) == want


@supplied
def test_quality_contract_columns(spark):
    for r in QUERIES["op10_quality"](spark, FOLDER).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


# stages ----------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    """A small table folder: labels of prose and shouted junk, and one test item."""
    labels = [(i, int(i % 2), 0) for i in range(1000, 1200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def prose(i, n=60):
    import random

    rng = random.Random(i)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


def learnt():
    return [(i, prose(i) if i % 2 else " | ".join(w.upper() + "!!" for w in prose(i).split())) for i in range(1000, 1200)]


def out(spark, stage, texts, folder):
    rows = documents(spark, texts)
    kept = written(stage(spark, rows, folder))
    assert kept.columns == rows.columns
    return [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]


def test_rejected_documents_go(spark, folder):
    kept = {r[0] for r in out(spark, corpus_pipeline.keep_good, learnt() + MESSY[2:5], folder)}
    wrong = [i for i in range(1000, 1200) if (i in kept) != bool(i % 2)]
    assert len(wrong) <= 4 and not kept & {3, 4}


def test_repeated_lines_go_and_lengths_follow(spark, folder):
    texts = [(1, "a\nb\nc"), (2, "a\nb\nd"), (3, "a\nb"), (4, None), (5, ""), (6, LONG), (7, "a")]
    kept = {k: (t, n) for k, t, n in out(spark, corpus_pipeline.drop_repeated_lines, texts, folder)}
    assert kept == {1: ("a\nb\nc", 5), 2: ("d", 1), 4: (None, 0), 5: ("", 0), 6: (LONG, len(LONG)), 7: ("a", 1)}


def test_a_long_repeated_line_goes_without_its_neighbours(spark, folder):
    long, short = prose(7, 52), prose(8, 49)
    texts = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}\ne"), (3, long), (4, short)]
    kept = {k: t for k, t, _ in out(spark, corpus_pipeline.drop_repeated_lines, texts, folder)}
    assert kept == {1: texts[0][1], 2: f"c\nd\n{short}\ne", 4: short}


def test_one_document_of_each_group_stays(spark, folder):
    base = prose(1, 200).split()
    near = list(base)
    near[50] = "changed"
    texts = [(10, " ".join(near)), (9, " ".join(base)), (12, " ".join(base)), (12, " ".join(base)), (13, prose(2, 200)), (14, None), (15, ""), (16, LONG), (17, LONG), (18, prose(1, 200)[:300])]
    kept = sorted(k for k, _, _ in out(spark, corpus_pipeline.drop_near_copies, texts, folder))
    assert kept == [9, 13, 14, 16, 18]
    twice = [(9, prose(3)), (9, prose(3)), (None, prose(4)), (None, prose(5))]
    assert len(out(spark, corpus_pipeline.drop_near_copies, twice, folder)) == 3


def test_a_column_named_like_the_mark_stays(spark, folder):
    rows = documents(spark, [(1, prose(1)), (2, prose(1)), (3, prose(2))]).selectExpr("*", "concat('m', doc_id) as _mark", "'n' as __mark")
    kept = corpus_pipeline.drop_near_copies(spark, rows, folder)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id, r["_mark"], r["__mark"]) for r in kept.collect()) == [(1, "m1", "n"), (3, "m3", "n")]


def test_contaminated_documents_go(spark, folder):
    test_words = "Alpha, beta gamma; delta epsilon zeta eta THETA iota kappa"
    texts = [(1, f"x {test_words} y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, None), (4, ""), (None, "x"), (6, LONG + " " + test_words)]
    kept = out(spark, corpus_pipeline.drop_contaminated, texts, folder)
    assert {k for k, _, _ in kept} == {2, 3, 4, None}
    assert all("kappa" not in brute_words(t) for _, t, _ in kept)


def test_encoding_is_lossless(spark, folder):
    rows = documents(spark, MESSY)
    found = corpus_pipeline.encode(spark, rows, folder).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.text is None)
    assert sorted(map(key, found)) == sorted(map(key, rows.collect()))
    assert all(r.n_ids == len(r.ids or ()) for r in found)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, folder, stage):
    assert stage(spark, empty(spark), folder).count() == 0


@supplied
def test_the_whole_pipeline(spark):
    """Stage by stage as the tool runs it, and in one go."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.text, tuple(r.ids)) for r in whole.collect()) == sorted((r.doc_id, r.text, tuple(r.ids)) for r in docs.collect())
    vocabulary = pieces.Vocabulary(MODEL)
    for r in whole.collect():
        assert b"".join(vocabulary.meaning[i] for i in r.ids).decode() == r.text
    assert len(DOCUMENTS) == 9
