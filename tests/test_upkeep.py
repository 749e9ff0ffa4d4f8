"""Summaries kept up month by month, and refused once the table has moved on."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import SF001
from ticketscope.operators import median as MED
from ticketscope.operators import metrics as M
from ticketscope.operators import summaries as SM
from ticketscope.operators.clean import clean, with_partition_keys
from ticketscope.operators.filters import TicketFilter
from ticketscope.plans import serving as V
from ticketscope.plans import upkeep as UP
from ticketscope.sources import files, stamps
from ticketscope.sources import fixtures as FX
from ticketscope.sources import storage as ST
from ticketscope.sources import summaries_io as SIO
from ticketscope.streaming.refresh import index_keys, merge_batch


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture()
def tickets(spark):
    """Fixture A over four months."""
    raw = FX.raw_tickets_a(spark, SF001)
    months = F.pmod(F.col("unique_key").cast("bigint"), F.lit(4)).cast("int")
    return clean(raw.withColumns({c: F.col(c) + F.make_ym_interval(F.lit(0), months) for c in ("created_date", "closed_date")}))


@pytest.fixture()
def kept(spark, tmp_dir, tickets):
    ST.write_clean_partitioned(tickets, f"{tmp_dir}/{ST.PARTITIONED}")
    months = UP.update(spark, tmp_dir, f"{tmp_dir}/summaries")
    assert len(months) >= 4
    return tmp_dir


def live_equals_stored(spark, root):
    now = ST.read_tickets(spark, root, view=None)
    stored = UP.current(spark, root, f"{root}/summaries")
    assert rows_of(stored["daily"].select(*SM.DAILY_COLUMNS)) == rows_of(SM.daily_summary(now))
    assert rows_of(stored["complaint_type"].select(*SM.TYPE_COLUMNS)) == rows_of(SM.type_summary(SM.daily_summary(now, detail=True)))
    assert rows_of(stored["dow_hour"].select(*SM.DOW_HOUR_COLUMNS)) == rows_of(SM.dow_hour_summary(now))
    routed = V.serve_seasonality(None, None, 24.0, summaries=stored)
    assert rows_of(routed) == rows_of(M.seasonality(now).withColumn("median_exact", F.lit(True)))


def test_update_reads_only_changed_months(spark, kept, tickets):
    out = f"{kept}/summaries"
    live_equals_stored(spark, kept)
    assert UP.update(spark, kept, out) == set()
    before = stamps.month_stamps(spark, f"{out}/daily_summary")
    # a late and a reopened ticket of one month
    row = tickets.where("month = 2").limit(1)
    merge_batch(row.withColumn("unique_key", F.lit("late")).drop("year"), f"{kept}/{ST.PARTITIONED}")
    assert UP.current(spark, kept, out) == {}
    assert set(UP.current(spark, kept, out, TicketFilter(start=dt.date(2024, 3, 1)))) == {"daily"}
    assert UP.current(spark, kept, out, TicketFilter(start=dt.date(2024, 2, 1), end=dt.date(2024, 2, 2))) == {}
    assert UP.update(spark, kept, out) == {(2024, 2)}
    after = stamps.month_stamps(spark, f"{out}/daily_summary")
    assert stamps.changed_months(before, after) == {(2024, 2)}
    live_equals_stored(spark, kept)


def test_removed_months_and_another_sla(spark, kept):
    out = f"{kept}/summaries"
    files.delete(spark, f"{kept}/{ST.PARTITIONED}/year=2024/month=3")
    assert UP.update(spark, kept, out) == {(2024, 3)}
    live_equals_stored(spark, kept)
    done = UP.update(spark, kept, out, 48.0)
    assert done == set(stamps.month_stamps(spark, f"{kept}/{ST.PARTITIONED}"))
    assert {r[0] for r in SIO.read_summaries(spark, out)["daily"].select("sla_hours").distinct().collect()} == {48.0}


def test_failed_update_is_done_again(spark, kept, tickets, monkeypatch):
    out = f"{kept}/summaries"
    merge_batch(tickets.where("month = 1").limit(3).withColumn("unique_key", F.concat(F.lit("x"), "unique_key")).drop("year"),
                f"{kept}/{ST.PARTITIONED}")

    def fail(*_):
        raise OSError("disk full")
    with monkeypatch.context() as m:
        m.setattr(UP, "dow_hour_from_runs", fail)
        with pytest.raises(OSError):
            UP.update(spark, kept, out)
    assert UP.current(spark, kept, out) == {}  # neither old nor half-new
    UP.update(spark, kept, out)
    live_equals_stored(spark, kept)


def test_runs_merge_exactly(spark):
    rows = [("Monday", 1, "a", None, 1.0, 3), ("Monday", 1, "a", None, 2.0, 3), ("Monday", 1, "a", None, None, 5), ("Monday", 1, "a", "x", 9.0, 1)]
    runs = spark.createDataFrame(rows, "dow_name string, hour int, borough string, complaint_type string, response_hours double, n long")
    got = {(r.borough, r.complaint_type): (r.tickets, r.open_tickets, r.within, r.median_response) for r in UP.dow_hour_from_runs(runs, 1.5).collect()}
    assert got == {("a", None): (11, 5, 3, statistics.median([1.0] * 3 + [2.0] * 3)), ("a", "x"): (1, 0, 0, 9.0)}


def test_index_is_written_as_the_table_is_read(spark, tmp_dir, tickets):
    """No month is gathered in a task: a month of several files is indexed by several tasks."""
    table = f"{tmp_dir}/{ST.PARTITIONED}"
    rows = with_partition_keys(tickets).select(*ST.PARTITIONED_SCHEMA.names)
    rows.repartition(3).write.partitionBy("year", "month").parquet(table)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        keys = index_keys(spark, table)
        january = keys.where("month = 1")
        assert january.select(F.input_file_name()).distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows_of(keys) == rows_of(rows.select("unique_key", "year", "month"))
    assert rows_of(index_keys(spark, table)) == rows_of(keys)  # nothing has changed


def test_medians_of_counts_are_stored_once(spark, monkeypatch):
    """Groups that pass a window whole aren't written a second time; larger ones are narrowed as before."""
    rows = [("a", float(v), 1 + v % 3) for v in range(50)] + [(None, 4.0, 2), (None, 6.0, 2), ("open", None, 9)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    want = {k: statistics.median(m) for k in ("a", None) if (m := [v for g, v, n in rows if g == k for _ in range(n)])}
    stored, plain = [], MED._stored
    monkeypatch.setattr(MED, "_stored", lambda *a: stored.append(a) or plain(*a))
    assert {r.k: r.m for r in MED.median_of_counts(df, ["k"], "v", "n", "m").collect()} == want
    assert len(stored) == 1
    assert {r.k: r.m for r in MED.median_of_counts(df, ["k"], "v", "n", "m", window_values=5).collect()} == want
    assert len(stored) > 2
