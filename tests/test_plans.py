"""Physical-plan properties: pushdown, pruning, join strategy, partial aggregation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SF001
from ticketscope.operators import exports as EX
from ticketscope.operators import metrics as M
from ticketscope.operators import summaries as SM
from ticketscope.operators.clean import clean
from ticketscope.operators.filters import TicketFilter
from ticketscope.plans.catalog import QUERIES
from ticketscope.sources import fixtures as FX
from ticketscope.sources import storage as ST


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df.collect()
    p = df._jdf.queryExecution().executedPlan()
    if p.nodeName() == "AdaptiveSparkPlan":
        p = p.executedPlan()
    return p.toString()


def test_fixture_join_broadcasts_the_dimension(spark):
    p = plan_of(FX.raw_tickets_a(spark, SF001).limit(1))
    assert "BroadcastHashJoin" in p


def test_clean_table_scan_pushes_filters_and_prunes_columns(spark, tmp_dir):
    ST.write_clean(clean(FX.raw_tickets_a(spark, SF001)), tmp_dir)
    df = ST.read_clean(spark, tmp_dir)
    flt = TicketFilter(start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 9), boroughs=["ASIA"])
    p = plan_of(M.kpi(df, flt, median_method="inline"))
    assert "GreaterThanOrEqual(created_dt,2024-01-05T00:00)" in p
    assert "LessThan(created_dt,2024-01-10T00:00)" in p
    assert "EqualTo(borough,ASIA)" in p or "In(borough, [ASIA])" in p
    # only the columns the KPI needs are read
    assert "ReadSchema: struct<created_dt:timestamp_ntz,borough:string,response_hours:double>" in p


def test_group_by_uses_partial_aggregation(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    p = plan_of(M.top_types(c))
    assert p.count("HashAggregate") >= 2 and "partial_" in p
    assert "TakeOrderedAndProject" in p


def test_holiday_and_strip_stay_in_generated_code(spark):
    c = clean(FX.raw_tickets_a(spark, SF001)).select("unique_key", "is_holiday", "borough")
    p = plan_of(c)
    assert "*(" in p                                  # whole-stage codegen around the project


HOT_GROUP_QUERIES = ("kpi_skew_safe", "daily_summary_skew_safe", "export_daily_borough_hot_groups")


@pytest.mark.parametrize("name", HOT_GROUP_QUERIES)
def test_hot_group_queries_never_gather_a_group(spark, monkeypatch, name):
    def median(*_):
        raise AssertionError("F.median keeps every value of a group in one map")
    monkeypatch.setattr(F, "median", median)
    assert QUERIES[name](spark, SF001).columns


def test_two_scan_median_equals_the_inline_one(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    for run in (M.kpi, SM.daily_summary, EX.export_daily_borough):
        exact, inline = (sorted(map(tuple, run(c, **o).collect()), key=str) for o in ({}, {"median_method": "inline"}))
        assert exact == inline and exact
