"""Named queries over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query maps the benchmark tables to tickets (``sources.fixtures``), runs
the engine's operators over the whole data and returns a lazy DataFrame (the
sinks of the round-trip queries write to a fresh folder under the session's
checkpoint location first). Float columns whose value depends on summation
order are not produced: rates are integer ratios and medians are exact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.functions import holidays as H
from ticketscope.functions import sla as S
from ticketscope.functions import text as X
from ticketscope.operators import exports as EX
from ticketscope.operators import metrics as M
from ticketscope.operators import quality as Q
from ticketscope.operators import sampling as SP
from ticketscope.operators import summaries as SM
from ticketscope.operators.clean import clean, rethreshold
from ticketscope.operators.filters import TicketFilter
from ticketscope.plans import refresh as RF
from ticketscope.plans import serving as V
from ticketscope.plans import upkeep as UP
from ticketscope.schema import SAMPLE_COLUMNS
from ticketscope.session import scratch_dir
from ticketscope.sources import csv_export as CSV
from ticketscope.sources import extract as E
from ticketscope.sources import fixtures as FX
from ticketscope.sources import storage as ST
from ticketscope.sources import summaries_io as SIO
from ticketscope.streaming import refresh as STR

SLA = 24.0

# Fixed query parameters shared with the SQL twins.
DEMO_FILTER = TicketFilter(start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20),
                           boroughs=("ASIA", "EUROPE"),
                           complaint_types=("click 0", "click 1", "view 2", "error 3", "purchase 1",
                                            "signup 2"))
EMPTY_FILTER = TicketFilter(boroughs=("NOWHERE",))
DATED_FILTER = TicketFilter(start=dt.date(2024, 1, 8), end=dt.date(2024, 1, 14))
WINDOW = (dt.date(2024, 1, 10), dt.date(2024, 1, 12))
PRUNE_FILTER = TicketFilter(start=dt.date(1996, 3, 1), end=dt.date(1996, 6, 30))

#: Median settings that force the narrowing of hot groups at test size.
NARROW = {"accuracy": 20, "window_values": 50}

Query = Callable[[SparkSession, str], DataFrame]


def clean_a(spark: SparkSession, sf: str) -> DataFrame:
    return clean(FX.raw_tickets_a(spark, sf), sla_hours=SLA)


def clean_skewed(spark: SparkSession, sf: str) -> DataFrame:
    return clean(FX.skewed_tickets_a(spark, sf), sla_hours=SLA)


def clean_a_window(spark: SparkSession, sf: str, flt: TicketFilter) -> DataFrame:
    """Clean tickets of fixture A for a dated filter: the raw scan is narrowed first by the
    filter's conservative source-time window, the exact filter runs on local time later."""
    raw = FX.raw_tickets_a(spark, sf)
    pre = flt.raw_predicate()
    return clean(raw if pre is None else raw.where(pre), sla_hours=SLA)


def clean_b(spark: SparkSession, sf: str) -> DataFrame:
    return clean(FX.raw_tickets_b(spark, sf), sla_hours=SLA)


def _stored(spark, sf, detail=True):
    """The summaries as the batch job stores them: the clean table is written, the three
    summaries are computed from it and written, and read back."""
    root = scratch_dir(spark, "summaries")
    ST.write_clean_partitioned(clean_a(spark, sf), f"{root}/{ST.PARTITIONED}")
    RF.precompute(spark, root, f"{root}/summaries", SLA, detail=detail)
    return SIO.read_summaries(spark, f"{root}/summaries")


def _ranked(df, *order):
    """With ``rank``: the place of each row as the query returns it. Row numbers over the stated
    order would only repeat the request, so the place is taken from the sorted partitions."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


# -- dashboard metrics ------------------------------------------------------
def q_kpi(spark, sf):
    return M.kpi(clean_a(spark, sf), None, SLA)


def q_kpi_filtered(spark, sf):
    return M.kpi(clean_a_window(spark, sf, DEMO_FILTER), DEMO_FILTER, SLA)


def q_kpi_empty(spark, sf):
    return M.kpi(clean_a(spark, sf), EMPTY_FILTER, SLA)


def q_kpi_open_met(spark, sf):
    return M.kpi(clean_a(spark, sf), None, SLA, open_tickets="met")


def q_kpi_open_breached(spark, sf):
    return M.kpi(clean_a(spark, sf), None, 48.0, open_tickets="breached")


def q_kpi_skew_safe(spark, sf):
    """All response hours in one group, a wide bracket and small windows: the candidates are
    narrowed in passes, and no window holds more than 50 values."""
    return M.kpi(clean_skewed(spark, sf), None, SLA, **NARROW)


def q_top_types(spark, sf):
    return M.top_types(clean_a(spark, sf), None, SLA, 10)


def q_top_types_resolved(spark, sf):
    return M.top_types(clean_a(spark, sf), None, SLA, 10, open_tickets="exclude")


def q_top_types_filtered(spark, sf):
    return M.top_types(clean_a_window(spark, sf, DEMO_FILTER), DEMO_FILTER, 72.0, 5)


def q_top_types_open_breached(spark, sf):
    return M.top_types(clean_a(spark, sf), None, SLA, 10, open_tickets="breached")


def q_seasonality_open_met(spark, sf):
    return M.seasonality(clean_a(spark, sf), None, SLA, open_tickets="met")


def q_seasonality(spark, sf):
    return M.seasonality(clean_a(spark, sf), None, SLA)


def q_seasonality_filtered(spark, sf):
    return M.seasonality(clean_a_window(spark, sf, DEMO_FILTER), DEMO_FILTER, 12.0)


def q_by_weekday(spark, sf):
    return M.by_weekday(clean_a(spark, sf), None, SLA)


def q_extent(spark, sf):
    return M.extent(clean_a(spark, sf))


def q_boroughs(spark, sf):
    return M.dimension_values(clean_a(spark, sf), "borough")


def q_complaint_types(spark, sf):
    return M.dimension_values(clean_a(spark, sf), "complaint_type")


def q_row_count(spark, sf):
    return M.row_count(clean_a(spark, sf))


def q_year_range(spark, sf):
    return M.year_range(clean_b(spark, sf))


# -- summaries and routing ------------------------------------------------
def q_daily_summary(spark, sf):
    return SM.newest_first(SM.daily_summary(clean_a(spark, sf), SLA))


def q_daily_summary_skew_safe(spark, sf):
    """Nine tenths of the tickets in one date, borough and complaint type."""
    return SM.newest_first(SM.daily_summary(clean_skewed(spark, sf), SLA, **NARROW))


def q_type_summary(spark, sf):
    """By way of the daily counts; their medians, which it doesn't use, aren't computed."""
    return SM.type_summary(SM.daily_summary(clean_a(spark, sf), SLA, detail=True, median_method="none"))


def q_dow_hour_summary(spark, sf):
    return SM.calendar_order(SM.dow_hour_summary(clean_a(spark, sf), SLA))


def q_serve_top_types(spark, sf):
    return V.serve_top_types(None, TicketFilter(boroughs=("ASIA", "AFRICA", "EUROPE")), SLA, 10,
                             summaries=_stored(spark, sf))


def q_serve_top_types_dated(spark, sf):
    return V.serve_top_types(None, DATED_FILTER, SLA, 10, open_tickets="exclude",
                             summaries=_stored(spark, sf))


def q_serve_top_types_breached(spark, sf):
    return V.serve_top_types(None, TicketFilter(complaint_types=("view 0", "view 1", "click 2",
                                                                 "error 3", "signup 0")),
                             SLA, 3, open_tickets="breached", summaries=_stored(spark, sf))


def q_serve_seasonality(spark, sf):
    """Counts and rates from the stored summary, the median exact on request."""
    return V.serve_seasonality(clean_a(spark, sf), None, SLA, summaries=_stored(spark, sf), exact_median=True)


def q_daily_trend(spark, sf):
    return V.serve_daily_trend(_stored(spark, sf), TicketFilter(boroughs=("AMERICA",)))


# -- exports, sampling, quality --------------------------------------------
def q_export_daily_borough(spark, sf):
    return EX.export_daily_borough(clean_a(spark, sf))


def q_export_daily_borough_hot_groups(spark, sf):
    """The same export with nine tenths of the tickets in one date and borough."""
    return EX.export_daily_borough(clean_skewed(spark, sf), **NARROW)


def q_export_type_breaches(spark, sf):
    return EX.export_type_breaches(clean_a(spark, sf))


def q_sample_view(spark, sf):
    return SP.sample_view(clean_a_window(spark, sf, DEMO_FILTER), DEMO_FILTER, limit=1200,
                          sla_hours=48.0,
                          columns=SAMPLE_COLUMNS + ["breach"])


def q_export_type_breaches_null_keys(spark, sf):
    """Types that start with "error" have lost all their keys."""
    c = clean_a(spark, sf)
    return EX.export_type_breaches(c.withColumn("unique_key", F.when(
        ~F.startswith("complaint_type", F.lit("error")), F.col("unique_key"))))


def q_random_sample(spark, sf):
    return SP.random_sample(clean_a(spark, sf), n=500, seed=7)


def q_sample_roundtrip(spark, sf):
    root = scratch_dir(spark, "sample")
    ST.write_clean_partitioned(clean_a(spark, sf), f"{root}/{ST.PARTITIONED}")
    return spark.read.parquet(SP.write_sample(spark, root, f"{root}/sample", n=700, seed=11)).drop("year")


def q_sample_columns(spark, sf):
    c = clean_a(spark, sf)
    return c.select(*SP.sample_columns(c.columns, ["unique_key", "borough", "hour"]))


# -- orders: the place of every row ---------------------------------------
def q_order_top_types(spark, sf):
    return _ranked(M.top_types(clean_a(spark, sf), None, SLA, 10)).select("rank", "complaint_type")


def q_order_seasonality(spark, sf):
    return _ranked(M.seasonality(clean_a(spark, sf), None, SLA)).select("rank", "dow_name", "hour")


def q_order_by_weekday(spark, sf):
    return _ranked(M.by_weekday(clean_a(spark, sf), None, SLA)).select("rank", "dow_name")


def q_order_export_days(spark, sf):
    return _ranked(EX.export_daily_borough(clean_a(spark, sf))).select("rank", "date", "borough")


def q_order_sample_view(spark, sf):
    return _ranked(SP.sample_view(clean_a(spark, sf), DEMO_FILTER, limit=1200)).select("rank", "unique_key")


def q_order_extract_limited(spark, sf):
    return _ranked(E.extract(FX.raw_tickets_a(spark, sf), *WINDOW, limit=500)).select("rank", "unique_key")


def q_quality_report(spark, sf):
    return Q.quality_report(clean_b(spark, sf))


def q_quality_report_clean(spark, sf):
    return Q.quality_report(clean_a(spark, sf))


# -- row-level features -----------------------------------------------------
def q_clean_tickets(spark, sf):
    return clean_a(spark, sf)


def q_time_features(spark, sf):
    return clean_b(spark, sf).select("unique_key", "created_dt", "date", "hour", "day_of_week",
                                     "dow_name", "month", "month_name")


def q_local_time(spark, sf):
    from ticketscope.functions.time import to_local
    raw = FX.raw_tickets_a(spark, sf).where(F.col("created_date").isNotNull())
    return raw.select("unique_key", "created_date", to_local("created_date").alias("created_dt"))


def q_local_time_zoned(spark, sf):
    """Zone-aware creation times in a session set to New York, cleaned."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    raw = FX.raw_tickets_a(other, sf)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instants = {c: F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c)))
                for c in ("created_date", "closed_date", "resolution_action_updated_date")}
    return clean(raw.withColumns(instants), sla_hours=SLA).select("unique_key", "created_dt", "hour", "response_hours")


def q_clipped_rates(spark, sf):
    """Hours over the SLA as a rate, clipped to [0, 1]."""
    return clean_b(spark, sf).select("unique_key", S.clip_rate(F.col("response_hours") / F.lit(2400.0)).alias("clipped"))


def q_response_hours(spark, sf):
    return clean_b(spark, sf).select("unique_key", "response_hours", "within_sla")


def q_sla_flags(spark, sf):
    return rethreshold(clean_a(spark, sf), 48.0).select(
        "unique_key", "response_hours", "within_sla", "breach")


def q_holiday_flags(spark, sf):
    return clean_b(spark, sf).select("date", "is_holiday").distinct()


def q_holiday_dates(spark, sf):
    return H.calendar_of(M.year_range(clean_b(spark, sf))).select("date")


def q_holiday_user_table(spark, sf):
    """Days flagged by a user table too: the first of each month seen."""
    b = clean_b(spark, sf)
    table = b.select(F.trunc("date", "month").alias("date"), F.lit("month start").alias("name"))
    raw = FX.raw_tickets_b(spark, sf)
    return clean(raw, sla_hours=SLA, holidays=table).select("date", "is_holiday").distinct()


def q_city_normalised(spark, sf):
    return clean_a(spark, sf).select("unique_key", "city")


def q_text_trimmed(spark, sf):
    o = FX.table(spark, sf, "orders")
    p = FX.table(spark, sf, "part")
    a = o.select(F.col("o_orderkey").alias("id"), X.strip("o_orderpriority").alias("stripped"),
                 X.title_case(X.strip("o_orderpriority")).alias("titled"))
    b = p.select(F.col("p_partkey").alias("id"), X.strip("p_name").alias("stripped"),
                 X.title_case(F.concat(F.lit(" "), F.col("p_name"), F.lit("'s 2nd\t")))
                 .alias("titled"))
    return a.withColumn("src", F.lit("orders")).unionByName(b.withColumn("src", F.lit("part")))


def q_lenient_parse(spark, sf):
    return E.parse_landed(FX.landed_text_a(spark, sf)).select(
        "unique_key", "created_date", "closed_date", "resolution_action_updated_date",
        "latitude", "longitude")


# -- extract and storage ----------------------------------------------------
def q_extract_window(spark, sf):
    return E.extract(FX.raw_tickets_a(spark, sf), *WINDOW)


def q_extract_limited(spark, sf):
    return E.extract(FX.raw_tickets_a(spark, sf), *WINDOW, limit=500)


def q_extract_plan(spark, sf):
    return E.extract_plan(FX.raw_tickets_a(spark, sf), *WINDOW, page_size=1000)


def q_extract_dry_run(spark, sf):
    return E.dry_run(FX.raw_tickets_a(spark, sf), "out", *E.resolve_window(
        "2024-01-10", env={"UNTIL_DATE": "2024-01-12"}), page_size=700)


def _windows(raw):
    """Two windows that cover the whole table: its first day to its middle one, and the rest."""
    lo, hi = raw.agg(F.min(F.to_date("created_date")), F.max(F.to_date("created_date"))).first()
    middle = lo + (hi - lo) // 2
    return (lo, middle), (middle + dt.timedelta(days=1), hi)


def q_raw_roundtrip(spark, sf):
    out = scratch_dir(spark, "raw")
    raw = FX.raw_tickets_a(spark, sf)
    (since, _), (_, until) = _windows(raw)
    # the same window again, with a later end: its pages are replaced
    E.write_raw(E.extract(raw, since, since), out, since, page_size=2500)
    E.write_raw(E.extract(raw, since, until), out, since, page_size=2500)
    return E.read_raw(spark, out)


def q_raw_pages(spark, sf):
    """The files that the sink leaves: rows, first and last key in order of creation."""
    out = scratch_dir(spark, "raw-pages")
    raw = FX.raw_tickets_a(spark, sf)
    (since, _), (_, until) = _windows(raw)
    E.write_raw(E.extract(raw, since, until), out, since, page_size=700)
    at = F.struct("created_date", "unique_key")
    return (E.read_raw(spark, out).groupBy(F.input_file_name().alias("file"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min_by("unique_key", at).alias("first_key"), F.max_by("unique_key", at).alias("last_key"))
            .drop("file"))


def q_raw_union_missing_columns(spark, sf):
    out = scratch_dir(spark, "raw-mixed")
    raw = FX.raw_tickets_a(spark, sf)
    odd = F.pmod(F.col("unique_key").cast("bigint"), F.lit(2)) == 1
    since = _windows(raw)[0][0]
    E.write_raw(raw.where(~odd), out, since)
    # a second landing written by another tool: two columns absent, city stored as int
    (raw.where(odd).drop("resolution_action_updated_date", "agency")
     .withColumn("city", F.when(F.col("city").isNull(), F.lit(None).cast("int")))
     .write.parquet(f"{out}/foreign"))
    return E.read_raw_mixed(spark, E.raw_folder(out, since), f"{out}/foreign")


def _land_mixed(spark, sf, folder):
    """Fixture A in one folder, as four writers would leave it: contract pages, pages of few columns
    with a column that is null throughout, pages with nanosecond (INT96) instants, and text."""
    other = spark.newSession()
    other.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    other.conf.set("spark.sql.parquet.int96RebaseModeInWrite", "CORRECTED")
    raw = FX.raw_tickets_a(other, sf)
    part = F.pmod(F.col("unique_key").cast("bigint"), F.lit(4))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    times = ("created_date", "closed_date", "resolution_action_updated_date")
    raw.where(part == 0).write.mode("append").parquet(folder)
    (raw.where(part == 1).select("unique_key", "created_date", "closed_date", "borough", "latitude",
                                 F.lit(None).cast("int").alias("city")).write.mode("append").parquet(folder))
    (raw.where(part == 2).withColumns({c: F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c))) for c in times})
     .write.mode("append").parquet(folder))
    FX.landed_text_a(other, sf).where(part == 3).write.mode("append").parquet(folder)


def q_raw_folder_mixed_files(spark, sf):
    out = scratch_dir(spark, "raw-files")
    _land_mixed(spark, sf, out)
    return E.read_raw_mixed(spark, out)


def q_clean_roundtrip(spark, sf):
    out = scratch_dir(spark, "clean-part")
    ST.write_clean_partitioned(clean_b(spark, sf), out)
    return ST.read_clean(spark, out)


def q_partition_pruned_scan(spark, sf):
    out = scratch_dir(spark, "clean-prune")
    ST.write_clean_partitioned(clean_b(spark, sf), out)
    return ST.scan_filtered(spark, out, PRUNE_FILTER).select(
        "unique_key", "created_dt", "response_hours", "year", "month")


def q_summaries_roundtrip(spark, sf):
    return _stored(spark, sf, detail=False)["daily"]


def q_summaries_roundtrip_types(spark, sf):
    return _stored(spark, sf, detail=False)["complaint_type"]


def q_summaries_roundtrip_dow_hour(spark, sf):
    return _stored(spark, sf, detail=False)["dow_hour"]


def q_clean_single_roundtrip(spark, sf):
    out = scratch_dir(spark, "clean-single")
    return ST.read_clean(spark, ST.write_clean(clean_b(spark, sf), out))


def q_csv_roundtrip(spark, sf):
    out = scratch_dir(spark, "exports")
    path = CSV.write_csv(EX.export_type_breaches(clean_a(spark, sf)), out,
                         "type_breaches")
    schema = T.StructType([T.StructField("complaint_type", T.StringType()),
                           T.StructField("tickets", T.LongType()),
                           T.StructField("breaches", T.LongType()),
                           T.StructField("breach_rate", T.DoubleType())])
    return CSV.read_csv(spark, path, schema)


def q_view_csv_roundtrip(spark, sf):
    out = scratch_dir(spark, "view-csv")
    cols = ["unique_key", "created_dt", "borough", "complaint_type", "response_hours", "within_sla"]
    view = SP.sample_view(clean_a(spark, sf), DEMO_FILTER, limit=1200)
    path = CSV.write_view_csv(view, out, "current_view", cols)
    return CSV.read_csv(spark, path, view.select(*cols).schema)


# -- batch and streaming refresh ---------------------------------------------
def _land_raw(spark, sf, out):
    """Land fixture A as two extract runs (two windows), as the ingest would."""
    raw = FX.raw_tickets_a(spark, sf)
    for since, until in _windows(raw):
        E.write_raw(E.extract(raw, since, until), out, since, page_size=2000)


def q_batch_refresh(spark, sf):
    root = scratch_dir(spark, "refresh")
    _land_raw(spark, sf, f"{root}/raw")
    RF.process(spark, f"{root}/raw", f"{root}/clean", SLA, min_rows=1000)
    RF.precompute(spark, f"{root}/clean", f"{root}/summaries", SLA)
    return SIO.read_summaries(spark, f"{root}/summaries")["complaint_type"].select(
        *SM.TYPE_COLUMNS)


def q_batch_quality(spark, sf):
    """The gates counted by the batch job's own write, of tickets of which every seventh has no creation time."""
    root = scratch_dir(spark, "gates")
    undated = F.pmod(F.col("unique_key").cast("bigint"), F.lit(7)) == 0
    raw = FX.raw_tickets_a(spark, sf).withColumn("created_date", F.when(~undated, F.col("created_date")))
    raw.write.parquet(f"{root}/raw")
    RF.process(spark, f"{root}/raw", f"{root}/clean", SLA)
    return RF.read_report(spark, f"{root}/clean")


def q_batch_quality_rejected(spark, sf):
    """The same of tickets with repeated keys and negative hours: the run fails, the report is stored."""
    root = scratch_dir(spark, "gates-rejected")
    FX.raw_tickets_b(spark, sf, full=True).write.parquet(f"{root}/raw")
    try:
        RF.process(spark, f"{root}/raw", f"{root}/clean", SLA, min_rows=1000)
    except Q.QualityError:
        return RF.read_report(spark, f"{root}/clean")
    raise AssertionError("repeated keys were published")


def q_incremental_clean(spark, sf):
    root = scratch_dir(spark, "stream")
    _land_raw(spark, sf, f"{root}/raw")
    STR.refresh_once(spark, f"{root}/raw", f"{root}/clean", f"{root}/_checkpoint", sla_hours=SLA)
    return ST.read_clean(spark, f"{root}/clean", ST.PARTITIONED_SCHEMA).drop("year")


def q_incremental_late_pages(spark, sf):
    """Landings out of order: first all tickets but every fourth, every twentieth of them still
    open; then those as closed, and every fourth, 400 days older than the rest."""
    root = scratch_dir(spark, "late")
    raw, eid = FX.raw_tickets_a(spark, sf), F.col("unique_key").cast("bigint")
    late, reopened = F.pmod(eid, F.lit(4)) == 0, F.pmod(eid, F.lit(20)) == 1
    ends = ("closed_date", "resolution_action_updated_date")
    first = raw.where(~late).withColumns({c: F.when(~reopened, F.col(c)) for c in ends})
    shift = F.expr("interval 400 days")
    old = raw.where(late).withColumns({c: F.col(c) - shift for c in ("created_date", *ends)})
    for landing in (first, raw.where(~late & reopened).unionByName(old)):
        landing.write.mode("append").parquet(f"{root}/raw")
        STR.refresh_once(spark, f"{root}/raw", f"{root}/clean", f"{root}/_checkpoint", sla_hours=SLA)
    return ST.read_clean(spark, f"{root}/clean", ST.PARTITIONED_SCHEMA).drop("year")


def q_incremental_moved_tickets(spark, sf):
    """All tickets, then every fourth again with times that are 400 days later: they change their month."""
    root = scratch_dir(spark, "moved")
    raw = FX.raw_tickets_a(spark, sf)
    times, shift = ("created_date", "closed_date", "resolution_action_updated_date"), F.expr("interval 400 days")
    moved = raw.where(F.pmod(F.col("unique_key").cast("bigint"), F.lit(4)) == 0).withColumns({c: F.col(c) + shift for c in times})
    for landing in (raw, moved):
        landing.write.mode("append").parquet(f"{root}/raw")
        STR.refresh_once(spark, f"{root}/raw", f"{root}/clean", f"{root}/_checkpoint", sla_hours=SLA)
    return ST.read_clean(spark, f"{root}/clean", ST.PARTITIONED_SCHEMA).drop("year")


def _kept_up(spark, sf, root, update_last=True):
    """Landings out of order, the summaries kept up after each (but the last, unless asked for):
    first tickets of every month but the last, some still open; then those as closed, and the rest."""
    raw, eid = FX.raw_tickets_a(spark, sf), F.col("unique_key").cast("bigint")
    # every fifth ticket 40 or 80 days older, so that there are several months
    age = F.make_dt_interval((F.pmod(eid, F.lit(5)) == 0).cast("int") * 40 * (1 + F.pmod(eid, F.lit(2)).cast("int")))
    aged = raw.withColumns({c: F.col(c) - age for c in ("created_date", "closed_date", "resolution_action_updated_date")})
    late, reopened = F.pmod(eid, F.lit(10)) == 5, F.pmod(eid, F.lit(50)) == 1
    first = aged.where(~late).withColumns({c: F.when(~reopened, F.col(c)) for c in ("closed_date", "resolution_action_updated_date")})
    for last, landing in ((False, first), (True, aged.where(late | reopened))):
        landing.write.mode("append").parquet(f"{root}/raw")
        STR.refresh_once(spark, f"{root}/raw", f"{root}/clean/{ST.PARTITIONED}", f"{root}/_checkpoint", sla_hours=SLA)
        if update_last or not last:
            UP.update(spark, f"{root}/clean", f"{root}/summaries", SLA)
    return ST.read_tickets(spark, f"{root}/clean", view=None)


def q_summaries_incremental(spark, sf):
    """The weekday-hour summary, merged from the runs of months done at different times."""
    root = scratch_dir(spark, "upkeep")
    _kept_up(spark, sf, root)
    return SIO.read_summaries(spark, f"{root}/summaries")["dow_hour"].select(*SM.DOW_HOUR_COLUMNS)


def q_summaries_incremental_daily(spark, sf):
    root = scratch_dir(spark, "upkeep-daily")
    _kept_up(spark, sf, root)
    return SIO.read_summaries(spark, f"{root}/summaries")["daily"].select(*SM.DAILY_COLUMNS)


def q_summaries_incremental_types(spark, sf):
    root = scratch_dir(spark, "upkeep-types")
    _kept_up(spark, sf, root)
    return SIO.read_summaries(spark, f"{root}/summaries")["complaint_type"].select(*SM.TYPE_COLUMNS)


def q_serve_seasonality_routed(spark, sf):
    """The default route: counts and exact medians from what is stored."""
    root = scratch_dir(spark, "upkeep-serve")
    _kept_up(spark, sf, root)
    return V.serve_seasonality(None, None, SLA, summaries=UP.current(spark, f"{root}/clean", f"{root}/summaries"))


def q_serve_after_refresh(spark, sf):
    """The table has changed since the summaries were built: they aren't used."""
    root = scratch_dir(spark, "upkeep-stale")
    tickets = _kept_up(spark, sf, root, update_last=False)
    return V.serve_top_types(tickets, None, SLA, 10, summaries=UP.current(spark, f"{root}/clean", f"{root}/summaries"))


def q_rebuild_drops_months(spark, sf):
    """Tickets of which every fourth is 400 days older, processed whole and then without those: the
    months that only they had are gone from both copies."""
    root = scratch_dir(spark, "rebuild")
    raw = FX.raw_tickets_a(spark, sf)
    old = F.pmod(F.col("unique_key").cast("bigint"), F.lit(4)) == 0
    aged = raw.withColumn("created_date", F.when(old, F.col("created_date") - F.expr("interval 400 days"))
                          .otherwise(F.col("created_date")))
    for name, rows in (("all", aged), ("fewer", raw.where(~old))):
        rows.write.parquet(f"{root}/{name}")
        RF.process(spark, f"{root}/{name}", f"{root}/clean", SLA)
    return ST.read_tickets(spark, f"{root}/clean", view=None).select("unique_key", "created_dt")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
