"""Flat extracts for BI tools: daily × borough and complaint-type breach rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.operators.filters import resolved
from ticketscope.operators.median import aggregate_with_median


def export_daily_borough(clean_df: DataFrame, median_method: str = "exact", **median) -> DataFrame:
    """Resolved tickets by date × borough: tickets (non-null keys), median, % within (stored flag)."""
    d = resolved(clean_df)
    out = aggregate_with_median(
        d, ["date", "borough"],
        [F.count("unique_key").alias("tickets"),
         F.avg(F.col("within_sla").cast("int")).alias("__within")],
        "response_hours", "median_response", method=median_method, **median)
    return out.select("date", "borough", "tickets", "median_response",
                      S.percent(F.col("__within")).alias("pct_within_sla")).orderBy(
        F.col("date").asc_nulls_last(), F.col("borough").asc_nulls_last())


def export_type_breaches(clean_df: DataFrame) -> DataFrame:
    """Resolved tickets by complaint type: tickets (non-null keys), breaches (stored flag),
    breach % (2 places; null if all keys of the type are null)."""
    d = resolved(clean_df)
    out = (d.groupBy("complaint_type")
           .agg(F.count("unique_key").alias("tickets"),
                F.sum((~F.col("within_sla")).cast("long")).alias("breaches")))
    rate = S.percent(S.safe_ratio(F.col("breaches"), F.col("tickets")))
    return out.select("complaint_type", "tickets", "breaches", rate.alias("breach_rate")).orderBy(
        F.col("tickets").desc(), F.col("complaint_type").asc_nulls_last())
