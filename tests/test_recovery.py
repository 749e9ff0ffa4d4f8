"""Merges that are broken off, and tickets that change their month."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import edge_raw
from ticketscope.operators.clean import clean
from ticketscope.sources import files, stamps, storage
from ticketscope.streaming import refresh as R


def rows_of(spark, table):
    return sorted(map(repr, spark.read.schema(storage.PARTITIONED_SCHEMA).parquet(table).collect()))


@pytest.fixture()
def batches(spark):
    """Three batches over several months: the second touches months of the first."""
    raw = edge_raw(spark).where("created_date is not null").dropDuplicates(["unique_key"])
    months = F.pmod(F.xxhash64("unique_key"), F.lit(3)).cast("int")
    aged = raw.withColumns({c: F.col(c) + F.make_ym_interval(F.lit(0), months) for c in ("created_date", "closed_date")})
    extra = aged.withColumn("unique_key", F.concat("unique_key", F.lit("-2")))
    late = aged.where("closed_date is not null").withColumn("closed_date", F.col("closed_date") + F.expr("interval 3 hours"))
    return [clean(aged), clean(extra), clean(late)]


def test_broken_off_between_two_months(spark, tmp_dir, batches, monkeypatch):
    whole, broken = f"{tmp_dir}/whole", f"{tmp_dir}/broken"
    for b in batches:
        R.merge_batch(b, whole)
    R.merge_batch(batches[0], broken)
    real = storage.write_clean_partitioned

    def first_month_only(rows, path, **kw):
        month = rows.select("year", "month").orderBy("year", "month").first()
        real(rows.where((F.col("year") == month.year) & (F.col("month") == month.month)), path, **kw)
        raise OSError("lost the driver")
    with monkeypatch.context() as m:
        m.setattr(storage, "write_clean_partitioned", first_month_only)
        with pytest.raises(OSError):
            R.merge_batch(batches[1], broken)
    assert files.exists(spark, f"{broken}{R.JOURNAL}/{R.COMPLETE}")
    assert R.recover(spark, broken) and not R.recover(spark, broken)
    R.merge_batch(batches[1], broken)  # the stream gives the batch again
    R.merge_batch(batches[2], broken)
    assert rows_of(spark, broken) == rows_of(spark, whole)


def test_broken_off_before_the_staging_is_whole(spark, tmp_dir, batches, monkeypatch):
    table = f"{tmp_dir}/table"
    R.merge_batch(batches[0], table)
    before = rows_of(spark, table)

    def fail(*_):
        raise OSError("lost the driver")
    with monkeypatch.context() as m:
        m.setattr(R, "latest_per_key", fail)
        with pytest.raises(OSError):
            R.merge_batch(batches[1], table)
    assert not R.recover(spark, table) and rows_of(spark, table) == before
    assert not files.exists(spark, f"{table}{R.JOURNAL}")
    R.merge_batch(batches[1], table)
    assert len(rows_of(spark, table)) == 2 * len(before)


def test_a_ticket_that_moves_to_another_month(spark, tmp_dir, batches):
    table = f"{tmp_dir}/table"
    R.merge_batch(batches[0], table)
    n = len(rows_of(spark, table))
    raw = edge_raw(spark).where("unique_key in ('at_sla', 'open')")
    R.merge_batch(clean(raw.withColumns({c: F.col(c) + F.expr("interval 200 days") for c in ("created_date", "closed_date")})), table)
    kept = spark.read.schema(storage.PARTITIONED_SCHEMA).parquet(table)
    assert kept.count() == n
    assert {r.created_dt.date() for r in kept.where("unique_key = 'at_sla'").collect()} == {dt.date(2024, 7, 28)}
    # the only ticket of a month leaves it: the month goes
    row = kept.limit(1).withColumn("unique_key", F.lit("alone")).withColumn("created_dt", F.expr("timestamp_ntz'2020-02-03 00:00:00'")).drop("year")
    R.merge_batch(row, table)
    assert (2020, 2) in stamps.month_stamps(spark, table)
    later = row.withColumn("created_dt", F.expr("timestamp_ntz'2020-03-03 00:00:00'")).withColumn("response_hours", F.lit(900.0))
    R.merge_batch(later, table)
    assert (2020, 2) not in stamps.month_stamps(spark, table) and (2020, 3) in stamps.month_stamps(spark, table)


def test_the_index_follows_a_rebuilt_table(spark, tmp_dir, batches):
    table = f"{tmp_dir}/table"
    R.merge_batch(batches[0], table)
    R.index_keys(spark, table)
    storage.write_clean_partitioned(batches[1].where("month = 2"), table)
    listed = {(r.unique_key, r.year, r.month) for r in R.index_keys(spark, table).collect()}
    held = {(r.unique_key, r.year, r.month) for r in spark.read.schema(storage.PARTITIONED_SCHEMA).parquet(table).collect()}
    assert listed == held
