"""The batch jobs end to end, as a scheduler would run them.

``process``: raw pages → clean table → quality gates (abort before writing) →
single dataset and year/month-partitioned dataset.
``precompute``: partitioned clean table → three summaries.
``export``: clean table → two time-stamped CSV extracts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ticketscope.operators import exports as EX
from ticketscope.operators import quality as Q
from ticketscope.operators import summaries as SM
from ticketscope.operators.clean import clean
from ticketscope.session import scratch_scope
from ticketscope.sources import csv_export as CSV
from ticketscope.sources import extract as E
from ticketscope.sources import files
from ticketscope.sources import storage as ST
from ticketscope.sources import summaries_io as SIO


#: The gates of the last run, below ``root``: (gate, violations, ok).
REPORT = "quality"


def process(spark: SparkSession, raw_dir: str, root: str, sla_hours: float = 24.0,
            min_rows: int = 0, max_undated: int | None = None) -> dict[str, str]:
    """Clean the raw pages and write both clean datasets under ``root``.

    The cleaned rows are written once to a staging folder next to the target (shared
    storage: it cuts the lineage, so a lost executor never forces a re-clean). That write
    counts its rows, the negative hours and the raw rows without a creation time, which
    are left out (more than ``max_undated`` of them fail the run); only the keys are read
    again, to count duplicates. The report is stored in ``root/quality`` in any case. Nothing
    is published when a gate fails (the staging folder is left for inspection). On success the staged
    table becomes the single dataset and feeds the partitioned one, which is built
    aside and swapped in whole, so months that are gone from the raw pages are gone
    from both. Pages may come from any writer, each file with its own schema.
    """
    gates = Q.WriteGates()
    cleaned = clean(gates.landed(E.read_raw_mixed(spark, raw_dir)), sla_hours=sla_hours)
    staging = os.path.join(root, "_staging", f"clean-{uuid.uuid4().hex[:12]}")
    ST.write_clean(gates.cleaned(cleaned), staging)
    report = os.path.join(root, REPORT)
    gates.report(ST.read_clean(spark, staging, cleaned.schema), min_rows, max_undated).coalesce(1).write.mode("overwrite").parquet(report)
    Q.enforce_report(read_report(spark, root))
    single = os.path.join(root, ST.SINGLE)
    files.replace_dir(spark, staging, single)
    part, fresh = os.path.join(root, ST.PARTITIONED), f"{staging}-by-month"
    ST.write_clean_partitioned(ST.read_clean(spark, single, cleaned.schema), fresh)
    files.replace_dir(spark, fresh, part)
    return {"single": single, "partitioned": part}


def read_report(spark: SparkSession, root: str) -> DataFrame:
    """The gates of the last ``process`` run into ``root``."""
    return spark.read.schema(Q.REPORT_SCHEMA).parquet(os.path.join(root, REPORT))


def precompute(spark: SparkSession, root: str, out_dir: str, sla_hours: float = 24.0,
               detail: bool = True) -> dict[str, str]:
    """Write the daily, complaint-type and weekday-hour summaries of the clean table."""
    tickets = ST.read_tickets(spark, root, view=None)
    with scratch_scope(spark):
        daily = SM.daily_summary(tickets, sla_hours, detail=True)
        daily_path = SIO.write_summaries({"daily": daily if detail else
                                          daily.select(*SM.DAILY_COLUMNS)}, out_dir)
        # the complaint-type summary re-aggregates the stored daily one (small), not the tickets
        stored_daily = SIO.read_summaries(spark, out_dir)["daily"]
        rest = {"complaint_type": SM.type_summary(stored_daily, detail=detail),
                "dow_hour": SM.dow_hour_summary(tickets, sla_hours, detail=detail)}
        return {**daily_path, **SIO.write_summaries(rest, out_dir)}


def export(spark: SparkSession, root: str, out_dir: str) -> dict[str, str]:
    tickets = ST.read_tickets(spark, root, view=None)
    with scratch_scope(spark):
        return _export(tickets, out_dir)


def _export(tickets, out_dir: str) -> dict[str, str]:
    return {
        "daily_borough": CSV.write_csv(EX.export_daily_borough(tickets), out_dir,
                                       "borough_days"),
        "complaint_type": CSV.write_csv(EX.export_type_breaches(tickets), out_dir,
                                        "type_breaches"),
    }
