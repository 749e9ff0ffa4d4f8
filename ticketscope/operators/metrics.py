"""Dashboard metrics over the clean ticket table (live queries).

Each metric takes a ``TicketFilter`` and an SLA in hours; ``open_tickets``
chooses how tickets without an end timestamp count (see ``functions.sla``).
The defaults are the reference behaviour of each metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.functions.time import sort_bounded, weekday_order
from ticketscope.operators.filters import TicketFilter, non_empty, resolved
from ticketscope.operators.median import aggregate_with_median

HOURS = "response_hours"


def _scope(df: DataFrame, flt: TicketFilter | None, open_tickets: str) -> DataFrame:
    S.check_policy(open_tickets)
    d = (flt or TicketFilter()).apply(df)
    return resolved(d) if open_tickets == "exclude" else d


def _within_rate(sla_hours: float, open_tickets: str):
    h = F.col(HOURS)
    ind = S.within_indicator(h, sla_hours)
    if open_tickets == "met":
        ind = F.when(h.isNull(), 1).otherwise(ind)
    return F.avg(ind)


def kpi(df: DataFrame, flt: TicketFilter | None = None, sla_hours: float = 24.0,
        open_tickets: str = "exclude", median_method: str = "exact", **median) -> DataFrame:
    """One row: ``med_hrs``, ``pct_within``, ``tickets`` (empty input → null, null, 0)."""
    d = _scope(df, flt, open_tickets)
    return aggregate_with_median(
        d, [], [_within_rate(sla_hours, open_tickets).alias("pct_within"),
                F.count(F.lit(1)).alias("tickets")],
        HOURS, "med_hrs", method=median_method, **median,
        order=["med_hrs", "pct_within", "tickets"])


def top_types(df: DataFrame, flt: TicketFilter | None = None, sla_hours: float = 24.0,
              topn: int = 10, open_tickets: str = "met") -> DataFrame:
    """Top ``topn`` complaint types by tickets with their breach rate (ties by name)."""
    d = _scope(df, flt, open_tickets)
    return (d.groupBy("complaint_type")
            .agg(F.count(F.lit(1)).alias("tickets"),
                 F.avg(S.breach_indicator(HOURS, sla_hours, open_tickets)).alias("breach_rate"))
            .orderBy(F.col("tickets").desc(), F.col("complaint_type").asc_nulls_last())
            .limit(int(topn)))


def seasonality(df: DataFrame, flt: TicketFilter | None = None, sla_hours: float = 24.0,
                open_tickets: str = "exclude", median_method: str = "exact") -> DataFrame:
    """Weekday × hour: ``tickets``, ``breach_rate``, ``median_response``."""
    d = _scope(df, flt, open_tickets)
    out = aggregate_with_median(
        d, ["dow_name", "hour"],
        [F.count(F.lit(1)).alias("tickets"),
         F.avg(S.breach_indicator(HOURS, sla_hours, open_tickets)).alias("breach_rate")],
        HOURS, "median_response", method=median_method, fixed_groups=True,
        order=["dow_name", "hour", "tickets", "breach_rate", "median_response"])
    return sort_bounded(out, weekday_order("dow_name"), "hour")


def by_weekday(df: DataFrame, flt: TicketFilter | None = None, sla_hours: float = 24.0,
               open_tickets: str = "exclude", median_method: str = "exact") -> DataFrame:
    """Per weekday: ``median_response``, ``breach_rate``, ``tickets``, ``pct_within``."""
    d = _scope(df, flt, open_tickets)
    out = aggregate_with_median(
        d, ["dow_name"],
        [F.avg(S.breach_indicator(HOURS, sla_hours, open_tickets)).alias("breach_rate"),
         F.count(F.lit(1)).alias("tickets")],
        HOURS, "median_response", method=median_method, fixed_groups=True,
        order=["dow_name", "median_response", "breach_rate", "tickets"])
    out = out.withColumn("pct_within", F.lit(1.0) - F.col("breach_rate").cast("double"))
    return sort_bounded(out, weekday_order("dow_name"))


def extent(df: DataFrame, ts_col: str = "created_dt") -> DataFrame:
    """First and last creation time and their dates."""
    return (df.agg(F.min(ts_col).alias("min_created"), F.max(ts_col).alias("max_created"))
            .withColumns({"min_date": F.col("min_created").cast("date"),
                          "max_date": F.col("max_created").cast("date")}))


def dimension_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null, non-empty values of a column."""
    return df.select(col).where(non_empty(col)).distinct().orderBy(col)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def year_range(df: DataFrame, ts_col: str = "created_dt") -> DataFrame:
    """First and last year present (sizes the holiday calendar)."""
    y = F.year(ts_col)
    return df.agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))
