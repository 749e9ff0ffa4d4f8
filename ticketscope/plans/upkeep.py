"""Summaries that are kept up to date month by month, and served only while they are.

Stored below one folder, with the stamps of the months that they were built from (``stamps``):

* ``daily_summary``, in year / month folders: a row per date, borough and complaint type;
* ``response_runs``, in year / month folders: per weekday, hour, borough and complaint type how many
  tickets took each response time (null: open). It is an exact, mergeable form of the
  distribution: runs of months, boroughs and types add up, and every count, rate and median of the
  weekday-hour grain follows from them;
* ``complaint_type_summary`` and ``dow_hour_summary``, merged from the first two.

``update`` compares the stamps with the table's: only the months that differ are read and replaced
(months that are gone are deleted), then the two merged summaries are built from the stored rows, not
from the tickets. ``current`` gives the summaries that the present table still agrees with; what
isn't there is answered from the tickets by ``plans.serving``.

A run that fails half-way leaves the old stamps, so the next run sees the same months as changed and
does them again; stamps are removed before anything is replaced, so that no reader takes a half-new
summary for a current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.operators import summaries as SM
from ticketscope.operators.filters import TicketFilter
from ticketscope.operators.median import median_of_counts
from ticketscope.session import scratch_scope
from ticketscope.sources import files, stamps
from ticketscope.sources import storage as ST
from ticketscope.sources import summaries_io as SIO

CELL = ["dow_name", "hour", "borough", "complaint_type"]
RUNS = "response_runs"


def _months(df: DataFrame, months: set) -> DataFrame:
    """The rows of some months; literals that prune the folders that are read."""
    pick = F.lit(False)
    for year, month in sorted(months):
        pick = pick | ((F.col("year") == year) & (F.col("month") == month))
    return df.where(pick)


def response_runs(tickets: DataFrame) -> DataFrame:
    """(year, month, cell, response_hours, n): the tickets of each response time."""
    d = tickets.where(F.col("created_dt").isNotNull())
    return (d.groupBy(F.year("created_dt").alias("year"), F.month("created_dt").alias("month"), *CELL, SM.HOURS)
            .agg(F.count(F.lit(1)).alias("n")))


def dow_hour_from_runs(runs: DataFrame, sla_hours: float) -> DataFrame:
    """The weekday-hour summary, exact medians included, from runs of any months."""
    h, n = F.col(SM.HOURS), F.col("n")
    late = h > F.lit(float(sla_hours))
    counts = runs.groupBy(*CELL).agg(
        F.sum("n").alias("tickets"), F.coalesce(F.sum(F.when(h.isNull(), n)), F.lit(0)).alias("open_tickets"),
        F.coalesce(F.sum(F.when(late, n)), F.lit(0)).alias("breaches"),
        F.coalesce(F.sum(F.when(~late, n)), F.lit(0)).alias("within"))
    medians = median_of_counts(runs, CELL, SM.HOURS, "n", "median_response")
    right = medians.select(*[F.col(k).alias(f"__m_{k}") for k in CELL], "median_response")
    same = F.lit(True)
    for k in CELL:
        same = same & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    return (counts.join(right, same, "left")
            .withColumn("breach_rate", S.safe_ratio(F.col("breaches"), F.col("tickets")))
            .withColumn("sla_hours", F.lit(float(sla_hours)))
            .select(*SM.DOW_HOUR_COLUMNS, "open_tickets", "breaches", "within", "sla_hours"))


def _replace_months(df: DataFrame, path: str) -> None:
    (df.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month").parquet(path))


def update(spark: SparkSession, root: str, out_dir: str, sla_hours: float = 24.0) -> set:
    """Bring the summaries below `out_dir` up to the clean table below `root`. Gives the months that
    were done. Summaries built for another SLA are all done again."""
    table = f"{root}/{ST.PARTITIONED}"
    now = stamps.month_stamps(spark, table)
    before, sla = stamps.read_stamps(spark, out_dir)
    todo = stamps.changed_months(before if sla == float(sla_hours) else {}, now)
    if not todo:
        return todo
    files.delete(spark, f"{out_dir}/{stamps.STAMPS}")
    daily, runs = f"{out_dir}/daily_summary", f"{out_dir}/{RUNS}"
    if not before or sla != float(sla_hours):  # nothing that could be kept
        for path in (daily, runs):
            files.delete(spark, path)
    for year, month in todo - now.keys():
        for path in (daily, runs):
            files.delete(spark, f"{path}/year={year}/month={month}")
    with scratch_scope(spark):
        tickets = _months(ST.read_clean(spark, table, ST.PARTITIONED_SCHEMA), todo & now.keys())
        fresh = SM.daily_summary(tickets, sla_hours, detail=True)
        _replace_months(fresh.withColumns({"year": F.year("date"), "month": F.month("date")}), daily)
        _replace_months(response_runs(tickets), runs)
        stored = SIO.read_summaries(spark, out_dir)
        SIO.write_summaries({"complaint_type": SM.type_summary(stored["daily"], detail=True),
                             "dow_hour": dow_hour_from_runs(stored["runs"], sla_hours)}, out_dir)
    if stamps.month_stamps(spark, table) == now:  # else the table has changed since: all of it is done again
        stamps.write_stamps(spark, out_dir, now, sla_hours)
    return todo


def _within(month, flt: TicketFilter) -> bool:
    """Whether a filter's days reach a month."""
    return (month is None or ((flt.start is None or (flt.start.year, flt.start.month) <= month)
                              and (flt.end is None or month <= (flt.end.year, flt.end.month))))


def current(spark: SparkSession, root: str, out_dir: str, flt: TicketFilter | None = None) -> dict[str, DataFrame]:
    """The summaries that agree with the table as it is: the daily one if none of the months that
    the filter's days reach has changed, the others if no month has."""
    before, _ = stamps.read_stamps(spark, out_dir)
    if not before:
        return {}
    changed = stamps.changed_months(before, stamps.month_stamps(spark, f"{root}/{ST.PARTITIONED}"))
    stored = SIO.read_summaries(spark, out_dir)
    if not changed:
        return stored
    flt = flt or TicketFilter()
    return {"daily": stored["daily"]} if "daily" in stored and not any(_within(m, flt) for m in changed) else {}
