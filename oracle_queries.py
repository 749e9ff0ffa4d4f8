"""DuckDB twins of the registered Spark queries (the correctness oracle).

Each SQL text runs on the driver's pre-registered views (``events``,
``region``, ``orders``, ``lineitem``, …). The driver tables are first mapped to
raw tickets with the same fixture text as ``ticketscope.sources.fixtures``, then
cleaned with plain SQL, then queried. Nothing here is imported from the engine.
"""

from __future__ import annotations

import calendar
import datetime as dt

SLA = 24

RAW_A = """
select cast(event_id as string) as unique_key,
       ts as created_date,
       case when event_id % 5 <> 0 then ts + to_seconds(cast(floor(value*3600) as bigint)) end as closed_date,
       case when event_id % 10 = 0 then ts + to_seconds(cast(floor(value*3600) as bigint)) end
            as resolution_action_updated_date,
       concat('AG', cast(user_id % 3 as string)) as agency,
       concat(event_type, ' ', cast(user_id % 4 as string)) as complaint_type,
       event_type as descriptor,
       case when event_id % 10 = 5 then 'Open' else ' Closed ' end as status,
       r_name as borough,
       lpad(cast(user_id as string), 5, '0') as incident_zip,
       case when event_id % 4 <> 0 then concat('  o''brien ', lower(r_name), '-side ') end as city,
       case when event_id % 2 = 0 then 'PHONE' else 'ONLINE' end as open_data_channel_type,
       cast(40.5 as double) + (user_id % 100) / cast(200 as double) as latitude,
       cast(-74.2 as double) + (event_id % 100) / cast(200 as double) as longitude
from events join region on user_id % 5 = r_regionkey
"""

RAW_B = """
select concat(cast(o_orderkey as string), '-', cast(l_linenumber as string)) as unique_key,
       o_orderdate as created_date, l_shipdate as closed_date,
       cast(null as timestamp) as resolution_action_updated_date,
       o_orderpriority as complaint_type, o_orderstatus as status
from orders join lineitem on o_orderkey = l_orderkey
"""

# White space as Python's str.strip() sees it, and words as runs of cased letters, in RE2's terms.
_BLANK = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
_WORDS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip_sql(x: str) -> str:
    return f"regexp_replace(cast({x} as varchar), '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '{_WORDS}'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


def _weekday_of(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday 0) of a month; n = -1 is the last."""
    days = [dt.date(year, month, d) for d in range(1, calendar.monthrange(year, month)[1] + 1)]
    return [d for d in days if d.weekday() == weekday][n - 1 if n > 0 else n]


def holidays_between(first: int, last: int) -> list[dt.date]:
    """The days off of the New York calendar, from Python's own calendar (years from 1986 on)."""
    out = set()
    for y in range(first, last + 2):
        moved = [dt.date(y, 1, 1), dt.date(y, 7, 4), dt.date(y, 11, 11), dt.date(y, 12, 25)]
        if y >= 2021:
            moved.append(dt.date(y, 6, 19))
        for d in moved:  # also kept on the Friday before or the Monday after
            out |= {d, d - dt.timedelta(days=1) if d.weekday() == 5 else d + dt.timedelta(days=1) if d.weekday() == 6 else d}
        out |= {_weekday_of(y, 1, 0, 3), _weekday_of(y, 2, 0, 3), _weekday_of(y, 5, 0, -1), _weekday_of(y, 9, 0, 1),
                _weekday_of(y, 10, 0, 2), _weekday_of(y, 11, 3, 4), dt.date(y, 2, 12)}
        if y >= 2004:
            out.add(dt.date(y, 2, 15))
        if y >= 2015:
            out.add(_weekday_of(y, 11, 0, 1) + dt.timedelta(days=1))
    return sorted(d for d in out if first <= d.year <= last)


_DAYS_OFF = ", ".join(f"'{d}'" for d in holidays_between(1986, 2030))


def holiday_sql(d: str) -> str:
    return f"coalesce(list_contains(cast([{_DAYS_OFF}] as date[]), {d}), false)"


ALL_RAW = ["unique_key", "created_date", "closed_date", "resolution_action_updated_date",
           "agency", "complaint_type", "descriptor", "status", "borough", "incident_zip", "city",
           "open_data_channel_type", "latitude", "longitude"]
RAW_B_COLUMNS = ["unique_key", "created_date", "closed_date", "resolution_action_updated_date",
                 "complaint_type", "status"]


def clean_sql(raw: str, sla: float = SLA, present: list[str] = ALL_RAW) -> str:
    """Clean-table SQL over a raw-ticket SQL text (as CTEs ``raw_t`` → ``clean_t``)."""
    has = set(present)
    filled = f"coalesce({strip_sql('city')}, {strip_sql('borough')})"
    city = f"coalesce({strip_sql(title_sql(filled))}, 'Unknown')"
    cols = [
        "unique_key", "created_dt", "cast(created_dt as date) as date",
        "cast(hour(created_dt) as integer) as hour",
        "cast(isodow(created_dt) - 1 as integer) as day_of_week",
        "dayname(created_dt) as dow_name",
        "cast(month(created_dt) as integer) as month",
        "monthname(created_dt) as month_name",
        f"{holiday_sql('cast(created_dt as date)')} as is_holiday",
    ]
    for c in ["borough", "complaint_type", "descriptor", "agency", "status",
              "open_data_channel_type"]:
        if c in has:
            cols.append(f"{strip_sql(c)} as {c}")
    cols += ["response_hours", f"coalesce(response_hours <= {float(sla)}, false) as within_sla"]
    cols += [c for c in ["latitude", "longitude"] if c in has]
    if "incident_zip" in has:
        cols.append(f"{strip_sql('incident_zip')} as incident_zip")
    if "city" in has:
        cols.append(f"{city} as city")
    sel = ",\n         ".join(cols)
    return f"""
raw_t as ({raw}),
base_t as (
  select *, coalesce(closed_date, resolution_action_updated_date) as resp_end,
         timezone('America/New_York', timezone('UTC', created_date)) as created_dt
  from raw_t where created_date is not null),
feat_t as (
  select *, (cast(date_diff('microsecond', created_date, resp_end) as double) / 1e6) / 3600.0::double
            as response_hours
  from base_t),
clean_t as (
  select {sel}
  from feat_t)"""


CLEAN_A = "with " + clean_sql(RAW_A)
CLEAN_B = "with " + clean_sql(RAW_B, present=RAW_B_COLUMNS)


def q(body: str, clean: str = CLEAN_A) -> str:
    return f"{clean}\n{body}"


def qb(body: str) -> str:
    return q(body, CLEAN_B)


RH = "response_hours"
DEMO_WHERE = ("created_dt >= timestamp '2024-01-05 00:00:00' "
              "and created_dt < timestamp '2024-01-21 00:00:00' "
              "and borough in ('ASIA', 'EUROPE') and complaint_type in "
              "('click 0', 'click 1', 'view 2', 'error 3', 'purchase 1', 'signup 2')")
RAW_COLS = ", ".join(ALL_RAW)
WINDOW_WHERE = ("created_date >= timestamp '2024-01-10 00:00:00' "
                "and created_date < timestamp '2024-01-13 00:00:00'")


def _kpi(where: str, within: str) -> str:
    return q(f"""select median({RH}) as med_hrs, avg({within}) as pct_within,
                 count(*)::bigint as tickets from clean_t where {where}""")


def _top(where: str, breach: str, n: int) -> str:
    return q(f"""select complaint_type, count(*)::bigint as tickets, avg({breach}) as breach_rate
                 from clean_t where {where} group by complaint_type
                 order by tickets desc, complaint_type asc nulls last limit {n}""")


def _season(where: str, sla: float) -> str:
    return q(f"""select dow_name, hour, count(*)::bigint as tickets,
                 avg(case when {RH} > {sla} then 1 else 0 end) as breach_rate,
                 median({RH}) as median_response
                 from clean_t where {where} group by dow_name, hour""")


LANDED_A = f"""
with raw_t as ({RAW_A})
select unique_key,
  try_cast(case when cast(unique_key as bigint) % 7 = 3 then 'not a time ' || unique_key
                else replace(cast(created_date as varchar), ' ', 'T') end as timestamp) as created_date,
  try_cast(replace(cast(closed_date as varchar), ' ', 'T') as timestamp) as closed_date,
  try_cast(replace(cast(resolution_action_updated_date as varchar), ' ', 'T') as timestamp)
    as resolution_action_updated_date,
  try_cast(case when cast(unique_key as bigint) % 9 = 4 then 'n/a'
                else cast(latitude as varchar) end as double) as latitude,
  try_cast(cast(longitude as varchar) as double) as longitude
from raw_t"""


def _quality(clean: str, missing: int) -> str:
    return f"""{clean},
per_key as (select unique_key, count(*) as n, count_if({RH} < 0) as neg
            from clean_t group by unique_key),
tot as (select coalesce(sum(n), 0)::bigint as rows, coalesce(sum(neg), 0)::bigint as neg,
               coalesce(sum(case when n > 1 then n - 1 end), 0)::bigint as dups from per_key)
select 'required_columns' as gate, cast({missing} as bigint) as violations, {missing} = 0 as ok
union all select 'unique_key', dups, dups = 0 from tot
union all select 'non_negative_hours', neg, neg = 0 from tot
union all select 'min_rows', greatest(1000 - rows, 0)::bigint, rows >= 1000 from tot"""


# Every seventh ticket without a creation time.
UNDATED_A = "with " + clean_sql(f"""
select * replace (case when cast(unique_key as bigint) % 7 <> 0 then created_date end as created_date) from ({RAW_A})""")


def _batch_quality(clean: str, least: int) -> str:
    return _quality(clean, 0).replace("1000", str(least)) + """
union all select 'undated_rows', count_if(created_date is null)::bigint, true from raw_t"""


def _holiday_dates() -> str:
    return f"""{CLEAN_B},
span as (select min(year(created_dt)) as first_year, max(year(created_dt)) as last_year
         from clean_t)
select cast(d as date) as date
from span, generate_series(make_date(first_year, 1, 1), make_date(last_year, 12, 31),
                           interval 1 day) g(d)
where {holiday_sql('cast(d as date)')}"""


def _type_breaches(key: str = "unique_key") -> str:
    late = "sum(case when within_sla then 0 else 1 end)"
    return q(f"""select complaint_type, count({key})::bigint as tickets,
                 {late}::bigint as breaches,
                 round_even(cast({late} as double) / nullif(count({key}), 0) * 100.0::double, 2)
                   as breach_rate
                 from clean_t where {RH} is not null group by complaint_type""")


def _rank(body: str, order: str, columns: str, limit: int | None = None) -> str:
    """The place of every row in the stated order."""
    cut = f"where rank <= {limit}" if limit else ""
    return f"""select * from (select cast(row_number() over (order by {order}) as integer) as rank, {columns}
               from ({body})) {cut}"""


# Every fourth ticket 400 days older.
LATE_A = "with " + clean_sql(f"""
select * replace (created_date - to_days(cast(case when cast(unique_key as bigint) % 4 = 0 then 400 else 0 end as integer)) as created_date,
  closed_date - to_days(cast(case when cast(unique_key as bigint) % 4 = 0 then 400 else 0 end as integer)) as closed_date,
  resolution_action_updated_date - to_days(cast(case when cast(unique_key as bigint) % 4 = 0 then 400 else 0 end as integer))
    as resolution_action_updated_date)
from ({RAW_A})""") + " select * from clean_t"


def _aged(c: str) -> str:
    """A time that is older for every fifth ticket."""
    n = "cast(unique_key as bigint)"
    return f"{c} - to_days(cast(case when {n} % 5 = 0 then 40 * (1 + {n} % 2) else 0 end as integer)) as {c}"


# Every fifth ticket 40 or 80 days older.
AGED_A = "with " + clean_sql("select * replace ({}) from ({})".format(
    ", ".join(_aged(c) for c in ("created_date", "closed_date", "resolution_action_updated_date")), RAW_A))

# Nine tickets of ten in one hour, borough and complaint type.
_HOT = "cast(unique_key as bigint) % 10 <> 0"
_HOT_TIME = "timestamp '2024-01-10 15:00:00'"
SKEWED_A = "with " + clean_sql(f"""
select * replace (case when {_HOT} then {_HOT_TIME} else created_date end as created_date,
  case when {_HOT} then closed_date + ({_HOT_TIME} - created_date) else closed_date end as closed_date,
  case when {_HOT} then resolution_action_updated_date + ({_HOT_TIME} - created_date)
       else resolution_action_updated_date end as resolution_action_updated_date,
  case when {_HOT} then 'ASIA' else borough end as borough, case when {_HOT} then 'click 0' else complaint_type end as complaint_type)
from ({RAW_A})""")


def _on(sql: str, clean: str) -> str:
    """A twin over fixture A as one over another table of clean tickets."""
    assert sql.startswith(CLEAN_A)
    return clean + sql.removeprefix(CLEAN_A)


def oracles() -> dict[str, str]:
    out = _oracles()
    out |= {"kpi_skew_safe": _on(out["kpi"], SKEWED_A), "daily_summary_skew_safe": _on(out["daily_summary"], SKEWED_A),
            "export_daily_borough_hot_groups": _on(out["export_daily_borough"], SKEWED_A),
            "summaries_incremental": _on(out["dow_hour_summary"], AGED_A),
            "summaries_incremental_daily": _on(out["daily_summary"], AGED_A),
            "summaries_incremental_types": _on(out["type_summary"], AGED_A),
            "serve_seasonality_routed": _on(out["serve_seasonality"], AGED_A),
            "incremental_moved_tickets": LATE_A.replace("- to_days", "+ to_days"),
            "serve_after_refresh": _on(out["top_types"], AGED_A)}
    return out


def _oracles() -> dict[str, str]:
    s = float(SLA)
    within = f"case when {RH} <= {s} then 1 else 0 end"
    late = f"case when {RH} > {s} then 1 else 0 end"
    resolved = f"{RH} is not null"
    daily = q(f"""select date, borough, complaint_type, count(*)::bigint as tickets,
                  median({RH}) as median_response, avg({within}) as pct_within
                  from clean_t where created_dt is not null group by date, borough, complaint_type""")
    kpi = _kpi(resolved, within)
    titled_part = title_sql("concat(' ', p_name, '''s 2nd', chr(9))")
    return {
        "kpi": kpi,
        "kpi_filtered": _kpi(f"{resolved} and {DEMO_WHERE}", within),
        "kpi_empty": _kpi(f"{resolved} and borough in ('NOWHERE')", within),
        "kpi_open_met": _kpi(
            "true", f"case when {RH} is null then 1 when {RH} <= {s} then 1 else 0 end"),
        "kpi_open_breached": _kpi("true", f"case when {RH} <= 48.0 then 1 else 0 end"),
        "top_types": _top("true", late, 10),
        "top_types_resolved": _top(resolved, late, 10),
        "top_types_filtered": _top(DEMO_WHERE, f"case when {RH} > 72.0 then 1 else 0 end", 5),
        "seasonality": _season(resolved, s),
        "seasonality_open_met": _season("true", s),
        "top_types_open_breached": _top(
            "true", f"case when {RH} is null then 1 when {RH} > {s} then 1 else 0 end", 10),
        "serve_top_types_breached": _top(
            "complaint_type in ('view 0', 'view 1', 'click 2', 'error 3', 'signup 0')",
            f"case when {RH} is null then 1 when {RH} > {s} then 1 else 0 end", 3),
        "seasonality_filtered": _season(f"{resolved} and {DEMO_WHERE}", 12.0),
        "by_weekday": q(f"""select dow_name, median({RH}) as median_response,
                 avg({late}) as breach_rate, count(*)::bigint as tickets,
                 1.0::double - avg({late}) as pct_within
                 from clean_t where {resolved} group by dow_name"""),
        "extent": q("""select min(created_dt) as min_created, max(created_dt) as max_created,
                 cast(min(created_dt) as date) as min_date, cast(max(created_dt) as date) as max_date
                 from clean_t"""),
        "boroughs": q("""select distinct borough from clean_t
                 where borough is not null and borough <> ''"""),
        "complaint_types": q("""select distinct complaint_type from clean_t
                 where complaint_type is not null and complaint_type <> ''"""),
        "row_count": q("select count(*)::bigint as rows from clean_t"),
        "year_range": qb("""select cast(min(year(created_dt)) as integer) as first_year,
                 cast(max(year(created_dt)) as integer) as last_year from clean_t"""),
        "daily_summary": daily,
        "type_summary": q(f"""select complaint_type, borough, count(*)::bigint as tickets,
                 coalesce(cast(count(*) - count_if({RH} <= {s}) as double)
                          / nullif(count(*), 0), 0.0) as breach_rate
                 from clean_t where created_dt is not null group by complaint_type, borough"""),
        "dow_hour_summary": q(f"""select dow_name, hour, borough, complaint_type,
                 count(*)::bigint as tickets, avg({late}) as breach_rate,
                 median({RH}) as median_response
                 from clean_t where created_dt is not null
                 group by dow_name, hour, borough, complaint_type"""),
        "serve_top_types": _top("borough in ('ASIA', 'AFRICA', 'EUROPE')", late, 10),
        "serve_top_types_dated": _top(
            f"{resolved} and created_dt >= timestamp '2024-01-08 00:00:00' "
            f"and created_dt < timestamp '2024-01-15 00:00:00'", late, 10),
        "serve_seasonality": q(f"""select dow_name, hour, count(*)::bigint as tickets,
                 avg({late}) as breach_rate, median({RH}) as median_response, true as median_exact
                 from clean_t where {resolved} group by dow_name, hour"""),
        "daily_trend": q(f"""select date, count(*)::bigint as tickets,
                 cast(count_if({RH} <= {s}) as double) / count(*) as pct_within
                 from clean_t where borough in ('AMERICA') group by date"""),
        "export_daily_borough": q(f"""select date, borough, count(unique_key)::bigint as tickets,
                 median({RH}) as median_response,
                 round_even(avg(cast(within_sla as integer)) * 100.0::double, 2) as pct_within_sla
                 from clean_t where {resolved} group by date, borough"""),
        "export_type_breaches": _type_breaches(),
        "sample_view": q(f"""select unique_key, created_dt, borough, complaint_type, descriptor,
                 {RH}, coalesce({RH} <= 48.0, false) as within_sla, hour, dow_name, month_name,
                 not coalesce({RH} <= 48.0, false) as breach
                 from clean_t where {DEMO_WHERE}
                 order by created_dt asc nulls last, unique_key asc nulls last limit 1200"""),
        "quality_report": _quality(CLEAN_B, 2),
        "quality_report_clean": _quality(CLEAN_A, 0),
        "clean_tickets": q("select * from clean_t"),
        "time_features": qb("""select unique_key, created_dt, date, hour, day_of_week, dow_name,
                 month, month_name from clean_t"""),
        "local_time": q("select unique_key, created_dt, created_date from base_t"),
        "response_hours": qb(f"select unique_key, {RH}, within_sla from clean_t"),
        "sla_flags": q(f"""select unique_key, {RH}, coalesce({RH} <= 48.0, false) as within_sla,
                 not coalesce({RH} <= 48.0, false) as breach from clean_t"""),
        "holiday_flags": qb("select distinct date, is_holiday from clean_t"),
        "holiday_dates": _holiday_dates(),
        "city_normalised": q("select unique_key, city from clean_t"),
        "text_trimmed": f"""
select o_orderkey as id, {strip_sql('o_orderpriority')} as stripped,
       {title_sql(strip_sql('o_orderpriority'))} as titled, 'orders' as src from orders
union all
select p_partkey as id, {strip_sql('p_name')} as stripped, {titled_part} as titled,
       'part' as src from part""",
        "lenient_parse": LANDED_A,
        "extract_window": f"""with raw_t as ({RAW_A})
                 select {RAW_COLS} from raw_t where {WINDOW_WHERE}""",
        "extract_limited": f"""with raw_t as ({RAW_A})
                 select {RAW_COLS} from raw_t where {WINDOW_WHERE}
                 order by created_date, unique_key limit 500""",
        "extract_plan": f"""with raw_t as ({RAW_A})
                 select count(*)::bigint as rows_in_window, count(*)::bigint as rows_to_fetch,
                 cast(ceil(count(*) / 1000.0) as bigint) as pages
                 from raw_t where {WINDOW_WHERE}""",
        "extract_dry_run": f"""with raw_t as ({RAW_A})
                 select count(*)::bigint as rows_in_window, count(*)::bigint as rows_to_fetch,
                 cast(ceil(count(*) / 700.0) as bigint) as pages, 'out/since=2024-01-10' as folder
                 from raw_t where {WINDOW_WHERE}""",
        "raw_pages": f"""with raw_t as ({RAW_A}),
            placed as (select unique_key, row_number() over (order by created_date, unique_key) - 1 as place from raw_t)
            select count(*) as rows, arg_min(unique_key, place) as first_key, arg_max(unique_key, place) as last_key
            from placed group by place // 700""",
        "raw_roundtrip": f"with raw_t as ({RAW_A}) select {RAW_COLS} from raw_t",
        "raw_union_missing_columns": f"""with raw_t as ({RAW_A}),
                 split_t as (select *, cast(unique_key as bigint) % 2 = 0 as whole from raw_t)
                 select unique_key, created_date, closed_date,
                   case when whole then resolution_action_updated_date end as resolution_action_updated_date,
                   case when whole then agency end as agency,
                   complaint_type, descriptor, status, borough, incident_zip,
                   case when whole then city end as city,
                   open_data_channel_type, latitude, longitude
                 from split_t""",
        "raw_folder_mixed_files": f"""with raw_t as ({RAW_A}),
                 four_t as (select *, cast(unique_key as bigint) % 4 as part, cast(unique_key as bigint) as id from raw_t)
                 select unique_key,
                   case when part = 3 and id % 7 = 3 then null else created_date end as created_date, closed_date,
                   case when part <> 1 then resolution_action_updated_date end as resolution_action_updated_date,
                   case when part <> 1 then agency end as agency, case when part <> 1 then complaint_type end as complaint_type,
                   case when part <> 1 then descriptor end as descriptor, case when part <> 1 then status end as status, borough,
                   case when part <> 1 then incident_zip end as incident_zip, case when part <> 1 then city end as city,
                   case when part <> 1 then open_data_channel_type end as open_data_channel_type,
                   case when part = 3 and id % 9 = 4 then null else latitude end as latitude,
                   case when part <> 1 then longitude end as longitude
                 from four_t""",
        "clean_roundtrip": qb("""select * exclude (month), cast(year(created_dt) as integer) as year,
                 cast(month(created_dt) as integer) as month from clean_t"""),
        "partition_pruned_scan": qb(f"""select unique_key, created_dt, {RH},
                 cast(year(created_dt) as integer) as year,
                 cast(month(created_dt) as integer) as month
                 from clean_t where created_dt >= timestamp '1996-03-01 00:00:00'
                 and created_dt < timestamp '1996-07-01 00:00:00'"""),
        "summaries_roundtrip": daily,
        "summaries_roundtrip_types": q(f"""select complaint_type, borough, count(*)::bigint as tickets,
                 coalesce(cast(count(*) - count_if({RH} <= {s}) as double)
                          / nullif(count(*), 0), 0.0) as breach_rate
                 from clean_t where created_dt is not null group by complaint_type, borough"""),
        "summaries_roundtrip_dow_hour": q(f"""select dow_name, hour, borough, complaint_type,
                 count(*)::bigint as tickets, avg({late}) as breach_rate, median({RH}) as median_response
                 from clean_t where created_dt is not null
                 group by dow_name, hour, borough, complaint_type"""),
        "clean_single_roundtrip": qb("select * from clean_t"),
        "incremental_clean": q("select * from clean_t"),
        "incremental_late_pages": LATE_A,
        "rebuild_drops_months": q("select unique_key, created_dt from clean_t where cast(unique_key as bigint) % 4 <> 0"),
        "local_time_zoned": q(f"select unique_key, created_dt, hour, {RH} from clean_t"),
        "clipped_rates": qb(f"select unique_key, greatest(0.0, least(1.0, {RH} / 2400.0::double)) as clipped from clean_t"),
        "holiday_user_table": qb(f"""select distinct date, is_holiday or dayofmonth(date) = 1 as is_holiday from clean_t"""),
        "export_type_breaches_null_keys": _type_breaches(
            "case when not starts_with(complaint_type, 'error') then unique_key end"),
        "sample_columns": q("select unique_key, borough, hour from clean_t"),
        "random_sample": q("select * from clean_t order by md5('7:' || unique_key), unique_key limit 500"),
        "sample_roundtrip": q("select * from clean_t order by md5('11:' || unique_key), unique_key limit 700"),
        "order_top_types": _rank(q("""select complaint_type, count(*) as tickets from clean_t group by complaint_type"""),
                                 "tickets desc, complaint_type nulls last", "complaint_type", 10),
        "order_seasonality": _rank(q(f"select distinct dow_name, hour, day_of_week from clean_t where {resolved}"),
                                   "day_of_week, hour", "dow_name, hour"),
        "order_by_weekday": _rank(q(f"select distinct dow_name, day_of_week from clean_t where {resolved}"),
                                  "day_of_week", "dow_name"),
        "order_export_days": _rank(q(f"select distinct date, borough from clean_t where {resolved}"),
                                   "date nulls last, borough nulls last", "date, borough"),
        "order_sample_view": _rank(q(f"select unique_key, created_dt from clean_t where {DEMO_WHERE}"),
                                   "created_dt nulls last, unique_key nulls last", "unique_key", 1200),
        "order_extract_limited": _rank(f"with raw_t as ({RAW_A}) select unique_key, created_date from raw_t where {WINDOW_WHERE}",
                                       "created_date, unique_key", "unique_key", 500),
        "view_csv_roundtrip": q(f"""select unique_key, created_dt, borough, complaint_type, {RH},
                 within_sla from clean_t where {DEMO_WHERE}
                 order by created_dt asc nulls last, unique_key asc nulls last limit 1200"""),
        "batch_quality": _batch_quality(UNDATED_A, 0),
        "batch_quality_rejected": _batch_quality(CLEAN_B, 1000),
        "batch_refresh": q(f"""select complaint_type, borough, count(*)::bigint as tickets,
                 coalesce(cast(count(*) - count_if({RH} <= {s}) as double)
                          / nullif(count(*), 0), 0.0) as breach_rate
                 from clean_t where created_dt is not null group by complaint_type, borough"""),
        "csv_roundtrip": _type_breaches(),
    }
