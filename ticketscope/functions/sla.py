"""Response-time and SLA expressions, and the open-ticket policy.

A ticket is *open* when it has no end timestamp, so ``response_hours`` is null.
Metrics treat open tickets in one of three ways, chosen per call:

* ``exclude``  — left out of the row set,
* ``met``      — counted as a ticket, never a breach,
* ``breached`` — counted as a ticket and as outside the SLA.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_POLICIES = ("exclude", "met", "breached")

MICROS_PER_SECOND = 1_000_000.0
SECONDS_PER_HOUR = 3600.0


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def response_end(closed: Column | str = "closed_date",
                 updated: Column | str = "resolution_action_updated_date") -> Column:
    """End of the response: the closing time, else the resolution update."""
    return F.coalesce(_c(closed), _c(updated))


def response_hours(start: Column | str, end: Column) -> Column:
    """Fractional hours between two timestamps at microsecond precision (null if open)."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), end)
    return (micros / F.lit(MICROS_PER_SECOND)) / F.lit(SECONDS_PER_HOUR)


def within_sla(hours: Column | str, sla_hours: float) -> Column:
    """``hours <= sla``; an open ticket (null hours) is not within the SLA."""
    return F.coalesce(_c(hours) <= F.lit(float(sla_hours)), F.lit(False))


def breach_indicator(hours: Column | str, sla_hours: float, open_tickets: str = "met") -> Column:
    """1 when the ticket breaches the SLA under the policy, else 0 (int)."""
    check_policy(open_tickets)
    h = _c(hours)
    late = F.when(h > F.lit(float(sla_hours)), 1).otherwise(0)
    if open_tickets == "breached":
        return F.when(h.isNull(), 1).otherwise(late)
    return late


def within_indicator(hours: Column | str, sla_hours: float) -> Column:
    """1 when ``hours <= sla`` else 0; open tickets score 0 (outside the SLA)."""
    return F.when(_c(hours) <= F.lit(float(sla_hours)), 1).otherwise(0)


def safe_ratio(num: Column, den: Column, if_zero: float | None = None) -> Column:
    """``num / den`` as double; zero denominator gives ``if_zero`` (null by default)."""
    r = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return r if if_zero is None else F.coalesce(r, F.lit(float(if_zero)))


def clip_rate(rate: Column | str) -> Column:
    """Clip a rate to [0, 1], keeping null."""
    r = _c(rate).cast("double")
    return F.when(r.isNull(), r).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))


def percent(rate: Column | str, places: int = 2) -> Column:
    """Rate × 100 rounded half-even."""
    return F.bround(_c(rate) * F.lit(100.0), places)


def check_policy(open_tickets: str) -> None:
    if open_tickets not in OPEN_POLICIES:
        raise ValueError(f"open_tickets must be one of {OPEN_POLICIES}, got {open_tickets!r}")
