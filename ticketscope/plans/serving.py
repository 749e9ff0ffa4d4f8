"""Answer dashboard queries from materialised summaries when that is exact.

Spark has no automatic view matching, so the routing is explicit:

* top complaint types — from the complaint-type summary when no date range is
  set, from the daily summary when one is (dates are whole days, so filtering
  the ``date`` grain is exact), else live;
* weekday × hour — ticket counts and breach rates from the weekday-hour
  summary when no date range is set; the median from the stored response runs,
  which merge exactly, where they are kept (``plans.upkeep``); else merged from
  per-row KLL sketches and flagged approximate, or, on request, computed from the
  tickets;
* weekday lines — always live.

A route is taken only when the summary was built for the same SLA. Summaries of
``upkeep.current`` are also known to agree with the table as it is. Counts are
kept per policy, so any ``open_tickets`` policy is answered exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.functions.time import sort_bounded, weekday_order
from ticketscope.operators import metrics as M
from ticketscope.operators import summaries as SM
from ticketscope.operators.filters import TicketFilter
from ticketscope.operators.median import median_of_counts


def summary_sla(df: DataFrame) -> float | None:
    if df is None or "sla_hours" not in df.columns:
        return None
    row = df.select("sla_hours").limit(1).collect()
    return float(row[0][0]) if row else None


def _date_range(df: DataFrame, flt: TicketFilter) -> DataFrame:
    if flt.start is not None:
        df = df.where(F.col("date") >= F.lit(flt.start))
    if flt.end is not None:
        df = df.where(F.col("date") <= F.lit(flt.end))
    return df


def _sla_of(summaries: dict, name: str, known_sla: float | None) -> float | None:
    if name not in summaries:
        return None
    return float(known_sla) if known_sla is not None else summary_sla(summaries[name])


def top_types_route(flt: TicketFilter, sla_hours: float, summaries: dict | None,
                    summary_sla_hours: float | None = None) -> str:
    s = summaries or {}
    if not flt.has_dates and _sla_of(s, "complaint_type", summary_sla_hours) == float(sla_hours):
        return "complaint_type"
    if _sla_of(s, "daily", summary_sla_hours) == float(sla_hours):
        return "daily"
    return "live"


def serve_top_types(clean_df: DataFrame | None, flt: TicketFilter | None = None,
                    sla_hours: float = 24.0, topn: int = 10, open_tickets: str = "met",
                    summaries: dict | None = None,
                    summary_sla_hours: float | None = None) -> DataFrame:
    """Top complaint types, from a summary when exact (``summary_sla_hours``: the SLA the
    summaries were built with, if known; else read from the summary rows)."""
    flt = flt or TicketFilter()
    route = top_types_route(flt, sla_hours, summaries, summary_sla_hours)
    if route == "live":
        return M.top_types(clean_df, flt, sla_hours, topn, open_tickets)
    if route == "complaint_type":
        rows = flt.apply_dimensions(summaries["complaint_type"])
        out = SM.reaggregate_types(rows, "late_resolved", open_tickets)
    else:
        rows = flt.apply_dimensions(_date_range(summaries["daily"], flt))
        out = SM.reaggregate_types(rows, "breaches", open_tickets)
    return (out.orderBy(F.col("tickets").desc(), F.col("complaint_type").asc_nulls_last())
            .limit(int(topn)))


def serve_seasonality(clean_df: DataFrame | None, flt: TicketFilter | None = None,
                      sla_hours: float = 24.0, open_tickets: str = "exclude",
                      summaries: dict | None = None, summary_sla_hours: float | None = None,
                      exact_median: bool = False) -> DataFrame:
    """Weekday × hour cells; ``median_exact`` tells whether the median is exact. A routed one comes
    from the response runs if the summaries have them; else it is merged from sketches unless
    ``exact_median`` asks for the tickets' own."""
    flt = flt or TicketFilter()
    s = summaries or {}
    dh = s.get("dow_hour")
    if flt.has_dates or _sla_of(s, "dow_hour", summary_sla_hours) != float(sla_hours):
        return M.seasonality(clean_df, flt, sla_hours, open_tickets) \
            .withColumn("median_exact", F.lit(True))
    rows = flt.apply_dimensions(dh)
    counts = SM.reaggregate_dow_hour(rows, open_tickets)
    if exact_median:
        med = M.seasonality(clean_df, flt, sla_hours, open_tickets).select("dow_name", "hour", "median_response")
        out = counts.join(med, ["dow_name", "hour"], "left")
    elif "runs" in s:
        runs = flt.apply_dimensions(s["runs"])
        med = median_of_counts(runs, ["dow_name", "hour"], SM.HOURS, "n", "median_response")
        out = counts.join(med, ["dow_name", "hour"], "left")
    elif "median_sketch" in rows.columns:
        merged = (rows.groupBy("dow_name", "hour")
                  .agg(F.kll_merge_agg_double("median_sketch").alias("__m")))
        # a cell with only open tickets has an empty sketch: no median
        med = merged.select("dow_name", "hour", F.when(
            F.kll_sketch_get_n_double("__m") > 0,
            F.kll_sketch_get_quantile_double("__m", F.lit(0.5))).alias("median_response"))
        out = counts.join(med, ["dow_name", "hour"], "left")
    else:
        out = counts.withColumn("median_response", F.lit(None).cast("double"))
    return sort_bounded(out.select("dow_name", "hour", "tickets", "breach_rate", "median_response",
                                   F.lit(exact_median or "runs" in s).alias("median_exact")),
                        weekday_order("dow_name"), "hour")


def serve_weekday(clean_df: DataFrame, flt: TicketFilter | None = None, sla_hours: float = 24.0,
                  open_tickets: str = "exclude") -> DataFrame:
    return M.by_weekday(clean_df, flt, sla_hours, open_tickets)


def serve_daily_trend(summaries: dict, flt: TicketFilter | None = None) -> DataFrame:
    """Daily time trend from the daily summary: tickets and share within the SLA per date."""
    flt = flt or TicketFilter()
    rows = flt.apply_dimensions(_date_range(summaries["daily"], flt))
    return (rows.groupBy("date")
            .agg(F.sum("tickets").alias("tickets"), F.sum("within").alias("within"))
            .select("date", "tickets", S.safe_ratio(F.col("within"), F.col("tickets")).alias("pct_within"))
            .orderBy("date"))
