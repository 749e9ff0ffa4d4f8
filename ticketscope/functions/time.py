"""Local-time features computed on zone-less (TIMESTAMP_NTZ) wall-clock values.

Nothing here depends on the session time zone: the conversion is explicit and
every calendar field is extracted from the NTZ value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English weekday names, Monday first (weekday number 0 = Monday).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# English month names, January first.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_local(col: Column | str, source_tz: str = "UTC", local_tz: str = "America/New_York",
             data_type: T.DataType | None = None) -> Column:
    """Wall-clock time in ``local_tz``.

    Zone-less input is read as ``source_tz``; zone-aware input (TIMESTAMP) is an
    instant and is only converted, whatever the session's zone.
    """
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(F.lit("UTC"), F.lit(local_tz), utc_clock(col))
    return F.convert_timezone(F.lit(source_tz), F.lit(local_tz), _c(col))


def utc_clock(col: Column | str) -> Column:
    """The UTC wall clock (TIMESTAMP_NTZ) of an instant, independent of the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(col)),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def weekday_name(col: Column | str) -> Column:
    """Full English weekday name of a date/timestamp."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(_c(col)) + 1)


def month_name(col: Column | str) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.element_at(names, F.month(_c(col)))


def weekday_order(name_col: Column | str) -> Column:
    """Monday=0 … Sunday=6 from a weekday name (for calendar ordering)."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return (F.array_position(names, _c(name_col)) - 1).cast("int")


def time_features(ts: Column | str) -> dict[str, Column]:
    """date, hour, day_of_week (0=Mon), dow_name, month, month_name of an NTZ column."""
    t = _c(ts)
    return {
        "date": t.cast("date"),
        "hour": F.hour(t).cast("int"),
        "day_of_week": F.weekday(t).cast("int"),
        "dow_name": weekday_name(t),
        "month": F.month(t).cast("int"),
        "month_name": month_name(t),
    }


def sort_bounded(df, *cols):
    """Order a result whose size is bounded by construction (7 × 24 weekday-hour cells,
    the values of one dimension): its rows are moved to one partition and sorted there.
    The aggregation above stays parallel, and no range-partition sampling job is needed."""
    return df.repartition(1).sortWithinPartitions(*cols)
