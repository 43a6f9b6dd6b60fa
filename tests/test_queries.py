"""Every registered query next to its SQL, and the shape of the plans."""

import os
import re

import pytest

import __spark_entry__ as registry
from check_queries import compare, open_tables
from ledgerloom.catalog.checks_sql import all_checks
from ledgerloom.catalog.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def db():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(all_queries()))
def test_same_rows_as_sql(spark, db, name):
    same, note = compare(spark, db, FOLDER, name)
    assert same, note


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(all_checks()) <= set(all_queries()) <= set(registry.queries())


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["month", "currency", "receipts", "total"] and frame.count() > 0


def plan_of(spark, name):
    frame = registry.queries()[name](spark, FOLDER)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(all_queries()))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "Python" not in plan and "InPandas" not in plan
    assert "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "usage_summary")
    pushed = re.findall(r"PushedFilters: \[[^\n]*", plan)
    assert any("GreaterThanOrEqual(ts" in p or "ts" in p for p in pushed)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "text_intake")).group(1)
    assert schema == "doc_id:bigint,text:string"


@pytest.mark.parametrize("name", ["duplicates_snapshot", "duplicates_replay", "delete_propagation", "pair_listing"])
def test_building_a_lookup_starts_no_job(spark, name):
    spark.range(1).count()
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        all_queries()[name](spark, FOLDER)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading the footer of a Parquet file is a job of one task.
    assert all(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) == 1 for j in jobs)


def test_category_joins_meet_a_broadcast_dimension(spark):
    plan = plan_of(spark, "category_bridge")
    assert not re.search(r"SortMergeJoin \[category(_id)?#", plan)
