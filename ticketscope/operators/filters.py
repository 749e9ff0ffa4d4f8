"""Ticket filters as Catalyst ``Column`` predicates (pushed into the Parquet scan).

``TicketFilter`` is the conjunctive filter of the dashboard: a creation-date
range (end date inclusive, evaluated half-open as ``< end + 1 day``) and
optional borough / complaint-type lists (an empty list means no predicate).
On a table partitioned by ``year``/``month`` it also emits a predicate on the
partition columns so that whole folders are skipped.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(v) -> dt.date | None:
    if v is None:
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v)[:10])


def ntz_literal(value: dt.date | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (Python datetimes would become zone-aware literals)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class TicketFilter:
    start: dt.date | None = None
    end: dt.date | None = None
    boroughs: tuple[str, ...] = field(default_factory=tuple)
    complaint_types: tuple[str, ...] = field(default_factory=tuple)
    ts_col: str = "created_dt"

    def __post_init__(self):
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        object.__setattr__(self, "boroughs", tuple(self.boroughs or ()))
        object.__setattr__(self, "complaint_types", tuple(self.complaint_types or ()))
        if self.start and self.end and self.start > self.end:
            raise ValueError(f"start {self.start} is after end {self.end}")

    # -- predicates ---------------------------------------------------------
    def date_predicate(self) -> Column | None:
        ts = F.col(self.ts_col)
        parts = []
        if self.start is not None:
            parts.append(ts >= ntz_literal(self.start))
        if self.end is not None:
            parts.append(ts < ntz_literal(self.end + dt.timedelta(days=1)))
        return _and(parts)

    def partition_predicate(self) -> Column | None:
        """``year*100+month`` bounds implied by the date range (for partition pruning)."""
        if self.start is None and self.end is None:
            return None
        ym = F.col("year") * 100 + F.col("month")
        parts = []
        if self.start is not None:
            parts.append(ym >= self.start.year * 100 + self.start.month)
        if self.end is not None:
            parts.append(ym <= self.end.year * 100 + self.end.month)
        return _and(parts)

    def raw_predicate(self, col: str = "created_date", max_offset_hours: int = 26) -> Column | None:
        """A superset of the date range on the raw (source-zone) creation time.

        Local and source wall clocks differ by less than ``max_offset_hours``, so
        widening the window by that much on both sides keeps every matching ticket.
        Applied before cleaning it reaches the raw Parquet scan (row-group skipping);
        the exact local-time filter still runs after cleaning.
        """
        ts = F.col(col)
        pad = dt.timedelta(hours=max_offset_hours)
        parts = []
        if self.start is not None:
            parts.append(ts >= ntz_literal(dt.datetime.combine(self.start, dt.time()) - pad))
        if self.end is not None:
            parts.append(ts < ntz_literal(dt.datetime.combine(self.end + dt.timedelta(days=1),
                                                              dt.time()) + pad))
        return _and(parts)

    def predicate(self, partitioned: bool = False) -> Column | None:
        parts = [self.date_predicate()]
        if self.boroughs:
            parts.append(F.col("borough").isin(list(self.boroughs)))
        if self.complaint_types:
            parts.append(F.col("complaint_type").isin(list(self.complaint_types)))
        if partitioned:
            parts.append(self.partition_predicate())
        return _and([p for p in parts if p is not None])

    def apply(self, df: DataFrame) -> DataFrame:
        partitioned = "year" in df.columns and "month" in df.columns
        p = self.predicate(partitioned=partitioned)
        return df if p is None else df.where(p)

    def apply_dimensions(self, df: DataFrame) -> DataFrame:
        """Borough / complaint lists only (for summary tables without timestamps)."""
        return TicketFilter(boroughs=self.boroughs, complaint_types=self.complaint_types).apply(df)

    @property
    def has_dates(self) -> bool:
        return self.start is not None or self.end is not None


def _and(parts: list[Column | None]) -> Column | None:
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def resolved(df: DataFrame, hours_col: str = "response_hours") -> DataFrame:
    """Tickets with an end timestamp (``response_hours`` not null)."""
    return df.where(F.col(hours_col).isNotNull())


def non_empty(col: str) -> Column:
    """Non-null and non-empty dimension value."""
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))


def compact_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep ``columns`` in that order, skipping those the frame lacks."""
    return df.select(*[c for c in columns if c in df.columns])
