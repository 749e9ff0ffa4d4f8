"""Pre-aggregated summaries (materialised aggregates) and their re-aggregation.

Every summary row keeps the counts from which each open-ticket policy follows
(``tickets``, ``open_tickets``, ``breaches`` = resolved and late, ``within`` =
resolved and in time), so a router can answer a live query exactly from it.
The reference's own columns are the default projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.functions.time import sort_bounded, weekday_order
from ticketscope.operators.median import aggregate_with_median

HOURS = "response_hours"

DAILY_COLUMNS = ["date", "borough", "complaint_type", "tickets", "median_response", "pct_within"]
TYPE_COLUMNS = ["complaint_type", "borough", "tickets", "breach_rate"]
DOW_HOUR_COLUMNS = ["dow_name", "hour", "borough", "complaint_type", "tickets", "breach_rate",
                    "median_response"]


def _count_columns(sla_hours: float):
    h = F.col(HOURS)
    return [
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(h.isNull()).alias("open_tickets"),
        F.count_if(h > F.lit(float(sla_hours))).alias("breaches"),
        F.count_if(h <= F.lit(float(sla_hours))).alias("within"),
    ]


def daily_summary(clean_df: DataFrame, sla_hours: float = 24.0, detail: bool = False,
                  median_method: str = "exact", **median) -> DataFrame:
    """Date × borough × complaint type: tickets, median, share within the SLA.

    Open tickets are in ``tickets`` and count as outside the SLA. Unordered: a stored
    summary is written in parallel and sorted when it is read (``newest_first``).
    """
    d = clean_df.where(F.col("created_dt").isNotNull())
    counts = _count_columns(sla_hours)
    out = aggregate_with_median(d, ["date", "borough", "complaint_type"], counts, HOURS,
                                "median_response", method=median_method, **median)
    out = out.withColumn("pct_within", S.safe_ratio(F.col("within"), F.col("tickets")))
    out = out.withColumn("sla_hours", F.lit(float(sla_hours)))
    cols = DAILY_COLUMNS + (["open_tickets", "breaches", "within", "sla_hours"] if detail else [])
    return out.select(*cols)


def newest_first(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.col("date").desc())


def type_summary(daily: DataFrame, detail: bool = False) -> DataFrame:
    """Re-aggregate the daily summary to complaint type × borough over all dates.

    ``breaches`` = Σ tickets·(1 − pct_within): open tickets count as breaches.
    With the daily detail counts this is the exact integer ``Σ (tickets − within)``.
    """
    if "within" in daily.columns:
        breaches = F.sum(F.col("tickets") - F.col("within")).cast("double")
    else:
        breaches = F.sum(F.col("tickets") * (F.lit(1.0) - F.col("pct_within")))
    extra = []
    if detail:
        extra = [F.sum("open_tickets").alias("open_tickets"),
                 F.sum("breaches").alias("late_resolved"),
                 F.sum("within").alias("within"), F.first("sla_hours").alias("sla_hours"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    out = (daily.groupBy("complaint_type", "borough")
           .agg(F.sum("tickets").alias("tickets"), breaches.alias("breaches"), *extra))
    out = out.withColumn("breach_rate", S.safe_ratio(F.col("breaches"), F.col("tickets"), 0.0))
    cols = TYPE_COLUMNS + (["breaches", "open_tickets", "late_resolved", "within", "sla_hours",
                            "first_date", "last_date"] if detail else [])
    return out.select(*cols)


def dow_hour_summary(clean_df: DataFrame, sla_hours: float = 24.0, detail: bool = False,
                     median_method: str = "exact") -> DataFrame:
    """Weekday × hour × borough × complaint type: tickets, breach rate, median.

    Open tickets are in ``tickets`` but are not breaches. The detailed form also
    carries a KLL sketch of response hours per row (mergeable, for routed medians),
    computed in the same aggregate.
    """
    d = clean_df.where(F.col("created_dt").isNotNull())
    aggs = _count_columns(sla_hours)
    extra = ["open_tickets", "breaches", "within", "sla_hours"]
    if detail:
        aggs.append(F.kll_sketch_agg_double(HOURS).alias("median_sketch"))
        extra.append("median_sketch")
    out = aggregate_with_median(d, ["dow_name", "hour", "borough", "complaint_type"],
                                aggs, HOURS, "median_response", method=median_method)
    out = out.withColumn("breach_rate", S.safe_ratio(F.col("breaches"), F.col("tickets")))
    out = out.withColumn("sla_hours", F.lit(float(sla_hours)))
    cols = DOW_HOUR_COLUMNS + (extra if detail else [])
    return out.select(*cols)


def calendar_order(dow_hour: DataFrame) -> DataFrame:
    return dow_hour.orderBy(weekday_order("dow_name"), "hour", "borough", "complaint_type")


def policy_rate(tickets: str, open_tickets: str, breaches: str, open_policy: str):
    """(numerator, denominator) of the breach rate under a policy, from summary counts."""
    S.check_policy(open_policy)
    t, o, b = F.col(tickets), F.col(open_tickets), F.col(breaches)
    if open_policy == "exclude":
        return b, t - o
    if open_policy == "met":
        return b, t
    return b + o, t


def reaggregate_types(rows: DataFrame, late_col: str, open_policy: str = "met") -> DataFrame:
    """Complaint-type grain from detailed summary rows of any finer grain.

    ``late_col`` names the count of resolved tickets beyond the SLA.
    """
    agg = (rows.groupBy("complaint_type")
           .agg(F.sum("tickets").alias("tickets"), F.sum("open_tickets").alias("open_tickets"),
                F.sum(late_col).alias("late")))
    num, den = policy_rate("tickets", "open_tickets", "late", open_policy)
    tickets = F.col("tickets") - F.col("open_tickets") if open_policy == "exclude" \
        else F.col("tickets")
    return (agg.select("complaint_type", tickets.alias("tickets"),
                       S.clip_rate(S.safe_ratio(num, den)).alias("breach_rate"))
            .where(F.col("tickets") > 0))


def reaggregate_dow_hour(rows: DataFrame, open_policy: str = "exclude") -> DataFrame:
    """Weekday × hour grain from detailed weekday-hour summary rows."""
    agg = (rows.groupBy("dow_name", "hour")
           .agg(F.sum("tickets").alias("tickets"), F.sum("open_tickets").alias("open_tickets"),
                F.sum("breaches").alias("late")))
    num, den = policy_rate("tickets", "open_tickets", "late", open_policy)
    tickets = F.col("tickets") - F.col("open_tickets") if open_policy == "exclude" \
        else F.col("tickets")
    return (agg.select("dow_name", "hour", tickets.alias("tickets"),
                       S.clip_rate(S.safe_ratio(num, den)).alias("breach_rate"))
            .where(F.col("tickets") > 0)
            .transform(lambda d: sort_bounded(d, weekday_order("dow_name"), "hour")))
