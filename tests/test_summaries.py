import math

import pytest
from pyspark.sql import functions as F

from helpers import SF01, SF001
from ticketscope.operators import metrics as M
from ticketscope.operators import summaries as SM
from ticketscope.operators.clean import clean
from ticketscope.operators.filters import TicketFilter
from ticketscope.plans import serving as V
from ticketscope.sources import fixtures as FX


@pytest.fixture(scope="module")
def data(spark):
    c = clean(FX.raw_tickets_a(spark, SF001)).cache()
    daily = SM.daily_summary(c, 24.0, detail=True).cache()
    s = {"daily": daily, "complaint_type": SM.type_summary(daily, detail=True),
         "dow_hour": SM.dow_hour_summary(c, 24.0, detail=True)}
    return c, s


def as_set(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("policy", ["met", "exclude", "breached"])
@pytest.mark.parametrize("flt", [TicketFilter(), TicketFilter(boroughs=["ASIA", "AFRICA"]),
                                 TicketFilter(start="2024-01-08", end="2024-01-14",
                                              complaint_types=["click 0", "view 1", "error 2"])])
def test_top_types_route_equals_live(data, policy, flt):
    c, s = data
    routed = V.serve_top_types(None, flt, 24.0, 50, policy, summaries=s)
    live = M.top_types(c, flt, 24.0, 50, policy)
    assert as_set(routed, ["complaint_type", "tickets", "breach_rate"]) == \
        as_set(live, ["complaint_type", "tickets", "breach_rate"])


def test_route_choice(data):
    _, s = data
    assert V.top_types_route(TicketFilter(), 24.0, s) == "complaint_type"
    assert V.top_types_route(TicketFilter(start="2024-01-02"), 24.0, s) == "daily"
    assert V.top_types_route(TicketFilter(), 48.0, s) == "live"        # other SLA: live
    assert V.top_types_route(TicketFilter(), 24.0, {}) == "live"


@pytest.mark.parametrize("policy", ["exclude", "met"])
def test_seasonality_route_counts_equal_live(data, policy):
    c, s = data
    flt = TicketFilter(boroughs=["EUROPE"])
    routed = V.serve_seasonality(None, flt, 24.0, policy, summaries=s)
    live = M.seasonality(c, flt, 24.0, policy)
    cols = ["dow_name", "hour", "tickets", "breach_rate"]
    assert as_set(routed, cols) == as_set(live, cols)
    # the merged-sketch median is one of the cell's own values, within its range
    r = {(x.dow_name, x.hour): x.median_response for x in routed.collect()}
    rng = {(x.dow_name, x.hour): (x.lo, x.hi) for x in flt.apply(c).groupBy("dow_name", "hour")
           .agg(F.min("response_hours").alias("lo"), F.max("response_hours").alias("hi")).collect()}
    for k, (lo, hi) in rng.items():
        if lo is not None:
            assert lo <= r[k] <= hi


def test_dated_seasonality_goes_live(data):
    c, s = data
    out = V.serve_seasonality(c, TicketFilter(start="2024-01-10"), 24.0, summaries=s)
    assert out.where(~F.col("median_exact")).count() == 0


def test_type_summary_reference_formula(data):
    """Σ tickets·(1−pct_within) equals the exact integer breaches up to float rounding."""
    _, s = data
    daily = s["daily"]
    ref = SM.type_summary(daily.select(*SM.DAILY_COLUMNS))            # float formula
    exact = SM.type_summary(daily)                                     # integer counts
    a = {(r.complaint_type, r.borough): r.breach_rate for r in ref.collect()}
    b = {(r.complaint_type, r.borough): r.breach_rate for r in exact.collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_daily_summary_open_tickets_are_outside_sla(data):
    c, s = data
    row = s["daily"].agg(F.sum("tickets").alias("t"), F.sum("within").alias("w"),
                         F.sum("open_tickets").alias("o")).first()
    assert row.t == c.count()
    assert row.o == c.where(F.col("response_hours").isNull()).count()
    assert row.w == c.where(F.col("response_hours") <= 24).count()


def test_daily_trend(data):
    _, s = data
    t = V.serve_daily_trend(s).collect()
    assert [r.date for r in t] == sorted(r.date for r in t)


def test_weekday_lines_and_rate_clip(data, spark):
    from ticketscope.functions.sla import clip_rate
    c, _ = data
    lines = V.serve_weekday(c).collect()
    assert all(abs(r.pct_within + r.breach_rate - 1.0) < 1e-12 for r in lines)
    df = spark.createDataFrame([(-0.5,), (0.25,), (1.5,), (None,)], "r double")
    assert [r.c for r in df.select(clip_rate("r").alias("c")).collect()] == [0.0, 0.25, 1.0, None]


def test_routed_median_is_within_its_rank_error(spark):
    """The sketch median of a cell lies within 3 % of its ranks of the middle; on request it is exact."""
    c = clean(FX.raw_tickets_a(spark, SF01)).where("response_hours is not null")
    summaries = {"dow_hour": SM.dow_hour_summary(c, 24.0, detail=True)}
    values = {}
    for r in c.select("dow_name", "hour", "response_hours").collect():
        values.setdefault((r.dow_name, r.hour), []).append(r.response_hours)
    for r in V.serve_seasonality(None, None, 24.0, summaries=summaries).collect():
        own = sorted(values[r.dow_name, r.hour])
        assert not r.median_exact
        below, upto = sum(v < r.median_response for v in own), sum(v <= r.median_response for v in own)
        assert below - 1 <= len(own) * 0.53 and upto + 1 >= len(own) * 0.47
    exact = V.serve_seasonality(c, None, 24.0, summaries=summaries, exact_median=True).collect()
    live = {(r.dow_name, r.hour): r.median_response for r in M.seasonality(c, None, 24.0).collect()}
    assert {(r.dow_name, r.hour): r.median_response for r in exact} == live
