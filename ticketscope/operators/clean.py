"""Feature engineering: raw tickets → clean tickets (one narrow, lazy plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.functions import holidays as H
from ticketscope.functions import sla as S
from ticketscope.functions import text as X
from ticketscope.functions import time as TM
from ticketscope.operators.filters import compact_projection
from ticketscope.schema import CLEAN_COLUMNS, TEXT_COLUMNS, TIMESTAMP_COLUMNS


def clean(raw: DataFrame, sla_hours: float = 24.0, source_tz: str = "UTC",
          local_tz: str = "America/New_York", holiday_region: str | None = "NY",
          holidays: DataFrame | None = None) -> DataFrame:
    """Clean ticket table from typed raw tickets.

    * rows without ``created_date`` are dropped,
    * ``response_hours`` from the closing time, else the resolution update,
    * ``within_sla`` is ``response_hours <= sla_hours`` and never null,
    * local-time features from ``created_date`` read in ``source_tz`` and shown in
      ``local_tz`` (zone-less wall clock, independent of the session zone; zone-aware
      columns are instants and first brought to their UTC wall clock),
    * ``is_holiday`` from the rule calendar (plus an optional ``(date, name)`` table),
    * text columns stripped of Unicode white space, ``city`` filled from
      ``borough``, title-cased, else ``Unknown``.
    """
    cols = set(raw.columns)
    df = raw.where(F.col("created_date").isNotNull())
    instants = [c for c in TIMESTAMP_COLUMNS
                if c in cols and isinstance(raw.schema[c].dataType, T.TimestampType)]
    df = df.withColumns({c: TM.utc_clock(c) for c in instants})

    end = S.response_end(
        F.col("closed_date") if "closed_date" in cols else F.lit(None).cast("timestamp_ntz"),
        F.col("resolution_action_updated_date") if "resolution_action_updated_date" in cols
        else F.lit(None).cast("timestamp_ntz"))
    hours = S.response_hours("created_date", end)
    local = TM.to_local("created_date", "UTC" if "created_date" in instants else source_tz, local_tz)

    new_cols = {"response_hours": hours, "created_dt": local}
    df = df.withColumns(new_cols)
    df = df.withColumn("within_sla", S.within_sla("response_hours", sla_hours))
    df = df.withColumns(TM.time_features("created_dt"))
    df = df.withColumn("is_holiday", H.is_holiday("date", holiday_region) if holiday_region
                       else F.lit(False))
    if holidays is not None:
        df = H.flag_with_table(df, holidays)

    text = {c: X.strip(c) for c in TEXT_COLUMNS if c in cols}
    df = df.withColumns(text)
    if "city" in cols:
        city = F.col("city")
        if "borough" in cols:
            city = F.coalesce(city, F.col("borough"))
        city = F.coalesce(X.strip(X.title_case(city)), F.lit("Unknown"))
        df = df.withColumn("city", city)
    return compact_projection(df, CLEAN_COLUMNS)


def with_partition_keys(clean_df: DataFrame) -> DataFrame:
    """Add ``year``/``month`` partition keys from the local creation time."""
    return clean_df.withColumns({"year": F.year("created_dt").cast("int"),
                                 "month": F.month("created_dt").cast("int")})


def rethreshold(clean_df: DataFrame, sla_hours: float) -> DataFrame:
    """Recompute ``within_sla`` for another SLA and add ``breach = NOT within_sla``."""
    return (clean_df.withColumn("within_sla", S.within_sla("response_hours", sla_hours))
            .withColumn("breach", ~F.col("within_sla")))
