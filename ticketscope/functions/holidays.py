"""Holiday calendar built from rules (no external package, no driver-side lists).

Rules are date expressions of a year column, so the same definitions give

* ``is_holiday(date)`` — a scalar, codegen-friendly membership test evaluated on
  each row for that row's own year (no join, no extra scan, no skew), and
* ``holiday_calendar(...)`` — a ``(date, name)`` table for any span of years.

Fixed-date holidays falling on a weekend are also observed on the nearest
weekday (Saturday → Friday before, Sunday → Monday after), as separate entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str          # "fixed" (month, day) or "nth" (month, weekday, n; n=-1 → last)
    month: int
    day: int = 0
    weekday: str = ""
    n: int = 0
    since: int = 0
    observed: bool = False


# US federal holidays (with first year in force) and the New York
# state additions, as assumed for the ``NY`` calendar.
FEDERAL_RULES = [
    Rule("New Year's Day", "fixed", 1, day=1, observed=True),
    Rule("Martin Luther King Jr. Day", "nth", 1, weekday="Mon", n=3, since=1986),
    Rule("Washington's Birthday", "nth", 2, weekday="Mon", n=3, since=1971),
    Rule("Memorial Day", "nth", 5, weekday="Mon", n=-1, since=1971),
    Rule("Juneteenth National Independence Day", "fixed", 6, day=19, since=2021, observed=True),
    Rule("Independence Day", "fixed", 7, day=4, observed=True),
    Rule("Labor Day", "nth", 9, weekday="Mon", n=1, since=1894),
    Rule("Columbus Day", "nth", 10, weekday="Mon", n=2, since=1971),
    Rule("Veterans Day", "fixed", 11, day=11, since=1978, observed=True),
    Rule("Thanksgiving", "nth", 11, weekday="Thu", n=4),
    Rule("Christmas Day", "fixed", 12, day=25, observed=True),
]
NY_RULES = [
    Rule("Lincoln's Birthday", "fixed", 2, day=12),
    Rule("Susan B. Anthony Day", "fixed", 2, day=15, since=2004),
    Rule("Election Day", "nth", 11, weekday="Tue", n=1, since=2015),
]


def rules_for(region: str | None = "NY") -> list[Rule]:
    return FEDERAL_RULES + (NY_RULES if region == "NY" else [])


def _rule_date(rule: Rule, year: Column) -> Column:
    if rule.kind == "fixed":
        return F.make_date(year, F.lit(rule.month), F.lit(rule.day))
    if rule.name == "Election Day":
        # Tuesday after the first Monday of November.
        first_monday = F.next_day(F.date_sub(F.make_date(year, F.lit(11), F.lit(1)), 1), "Mon")
        return F.date_add(first_monday, 1)
    if rule.n == -1:
        last = F.last_day(F.make_date(year, F.lit(rule.month), F.lit(1)))
        return F.next_day(F.date_sub(last, 7), rule.weekday)
    first = F.next_day(F.date_sub(F.make_date(year, F.lit(rule.month), F.lit(1)), 1), rule.weekday)
    return F.date_add(first, 7 * (rule.n - 1))


def _observed(d: Column) -> Column:
    dow = F.dayofweek(d)  # 1 = Sunday, 7 = Saturday
    return F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1))


def holiday_entries(year: Column, region: str | None = "NY") -> list[tuple[str, Column]]:
    """(name, date) expressions for one year; inactive or non-shifted entries are null."""
    out: list[tuple[str, Column]] = []
    for r in rules_for(region):
        d = _rule_date(r, year)
        active = year >= F.lit(r.since)
        out.append((r.name, F.when(active, d)))
        if r.observed:
            out.append((f"{r.name} (observed)", F.when(active, _observed(d))))
    return out


_DOW = {"Sun": 1, "Mon": 2, "Tue": 3, "Wed": 4, "Thu": 5, "Fri": 6, "Sat": 7}


def _since_map(entries: dict[int, int]) -> str:
    return "map(" + ", ".join(f"{code}, {since}" for code, since in entries.items()) + ")"


def is_holiday_sql(d: str, region: str | None = "NY") -> str:
    """SQL text of ``is_holiday`` for a date-valued SQL expression ``d``.

    A day is coded as month * 100 + day, and as month * 100 + weekday * 10 + its
    week in the month; constant maps give the first year in force of each code.
    """
    rules = rules_for(region)
    fixed = {r.month * 100 + r.day: r.since for r in rules if r.kind == "fixed"}
    moved = {r.month * 100 + r.day: r.since for r in rules if r.observed}
    plain = [r for r in rules if r.kind == "nth" and r.n > 0 and r.name != "Election Day"]
    weeks = {r.month * 100 + _DOW[r.weekday] * 10 + r.n: r.since for r in plain}

    def in_force(entries: dict[int, int], code: str, day: str) -> str:
        return f"coalesce(try_element_at({_since_map(entries)}, {code}) <= year({day}), false)"

    def day_code(x: str) -> str:
        return f"month({x}) * 100 + day({x})"
    nxt, prv = f"date_add({d}, 1)", f"date_sub({d}, 1)"
    terms = [in_force(fixed, day_code(d), d),
             f"(dayofweek({d}) = {_DOW['Fri']} AND {in_force(moved, day_code(nxt), nxt)})",
             f"(dayofweek({d}) = {_DOW['Mon']} AND {in_force(moved, day_code(prv), prv)})",
             in_force(weeks, f"month({d}) * 100 + dayofweek({d}) * 10 + (day({d}) + 6) div 7", d)]
    for r in rules:
        if r.kind == "nth" and r.n == -1:  # the last of a 31-day month: day 25..31
            terms.append(f"(month({d}) = {r.month} AND dayofweek({d}) = {_DOW[r.weekday]} AND day({d}) >= 25 AND year({d}) >= {r.since})")
        elif r.name == "Election Day":     # the Tuesday after the first Monday
            terms.append(f"(month({d}) = {r.month} AND dayofweek({d}) = {_DOW['Tue']} AND day({d}) BETWEEN 2 AND 8 AND year({d}) >= {r.since})")
    return "coalesce(" + " OR ".join(terms) + ", false)"


def is_holiday(date_col: str, region: str | None = "NY") -> Column:
    """True when the date column is a holiday or an observed holiday; null → False.

    Evaluated per row with look-ups of (month, day, weekday) in constant maps — the
    same calendar as ``holiday_calendar`` without building any date. The generated
    code is small enough for the JVM's compiler without any flag. A fixed-date
    holiday on Saturday is observed on the Friday before (the holiday is the
    next day), on Sunday on the Monday after (the holiday was the day before).
    """
    return F.expr(is_holiday_sql(f"`{date_col}`", region))


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int,
                     region: str | None = "NY", extra: DataFrame | None = None) -> DataFrame:
    """``(date, name)`` for the years ``first_year..last_year``, unique on date."""
    return calendar_of(spark.range(1).select(F.lit(first_year).alias("first_year"), F.lit(last_year).alias("last_year")),
                       region, extra)


def calendar_of(span: DataFrame, region: str | None = "NY", extra: DataFrame | None = None) -> DataFrame:
    """``(date, name)`` for the years of ``span`` (one row: ``first_year``, ``last_year``, such as
    ``metrics.year_range`` of a table), unique on date. Lazy.

    ``extra`` is an optional user table ``(date, name)`` unioned in (state or local days).
    Size is bounded by ~20 rows per year.
    """
    # one year past the end: New Year's Day of that year may be observed on 31 December
    years = span.where(F.col("first_year").isNotNull()).select(
        "first_year", "last_year", F.explode(F.sequence(F.col("first_year"), F.col("last_year") + 1)).alias("year"))
    entries = holiday_entries(F.col("year"), region)
    structs = F.array(*[F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in entries])
    cal = years.select("first_year", "last_year", F.inline(structs)).where(F.col("date").isNotNull())
    cal = cal.where(F.year("date").between(F.col("first_year"), F.col("last_year"))).select("date", "name")
    if extra is not None:
        cal = cal.unionByName(extra.select(F.col("date").cast("date"), F.col("name").cast("string")))
    return (cal.groupBy("date")
            .agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("name")))


def flag_with_table(df: DataFrame, calendar: DataFrame, date_col: str = "date",
                    out_col: str = "is_holiday") -> DataFrame:
    """Left-join membership against a user calendar table ``(date, name)``. Spark broadcasts it
    if its size is known to be small; else the join shuffles (AQE splits skewed dates)."""
    cal = calendar.select(F.col("date").cast("date").alias("__hd")).distinct()
    joined = df.join(cal, F.col(date_col) == F.col("__hd"), "left")
    prev = F.col(out_col) if out_col in df.columns else F.lit(False)
    return joined.withColumn(out_col, prev | F.col("__hd").isNotNull()).drop("__hd")
