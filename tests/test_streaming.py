import datetime as dt
import os

from helpers import SF001
from ticketscope.operators.clean import clean
from ticketscope.sources import extract as E
from ticketscope.sources import fixtures as FX
from ticketscope.sources import storage as ST
from ticketscope.streaming.refresh import refresh_once


def test_incremental_refresh_is_exactly_once_and_dedupes(spark, tmp_dir):
    raw = FX.raw_tickets_a(spark, SF001)
    raw_dir, out, ckpt = (os.path.join(tmp_dir, x) for x in ("raw", "clean", "ckpt"))
    first = E.extract(raw, "2024-01-01", "2024-01-15")
    E.write_raw(first, raw_dir, dt.date(2024, 1, 1), page_size=100)
    refresh_once(spark, raw_dir, out, ckpt)
    n1 = ST.read_clean(spark, out).count()
    assert n1 == clean(first).count()
    # a second landing: the rest of the month plus a re-sent page of the first window
    E.write_raw(E.extract(raw, "2024-01-16", "2024-01-31"), raw_dir, dt.date(2024, 1, 16))
    E.write_raw(first.limit(50), os.path.join(raw_dir, "resend"), dt.date(2024, 1, 1))
    refresh_once(spark, raw_dir, out, ckpt)
    refresh_once(spark, raw_dir, out, ckpt)            # nothing new: nothing appended
    got = ST.read_clean(spark, out)
    assert got.count() == clean(raw).count()
    assert got.select("unique_key").distinct().count() == got.count()


def test_late_and_reopened_tickets_are_merged(spark, tmp_dir):
    raw_dir, out, ckpt = (os.path.join(tmp_dir, x) for x in ("raw", "clean", "ckpt"))
    at = dt.datetime(2024, 6, 1, 12)

    def land(*rows):
        rows = [(k, c, e) for k, c, e in rows]
        spark.createDataFrame(rows, "unique_key string, created_date timestamp_ntz, closed_date timestamp_ntz") \
            .write.mode("append").parquet(raw_dir)
        refresh_once(spark, raw_dir, out, ckpt)
    land(("a", at, None), ("b", at, at + dt.timedelta(hours=5)), (None, at, None))
    land(("old", at - dt.timedelta(days=500), None), ("a", at, at + dt.timedelta(hours=2)))
    land(("b", at, None), ("b", at, at + dt.timedelta(hours=7)), (None, at, None))
    got = sorted(((r.unique_key, r.response_hours) for r in ST.read_clean(spark, out).collect()), key=str)
    assert got == sorted([("a", 2.0), ("b", 7.0), ("old", None), (None, None)], key=str)


def test_a_checkpoint_is_needed(spark, tmp_dir):
    try:
        refresh_once(spark, tmp_dir, tmp_dir, "")
    except ValueError:
        return
    raise AssertionError("a stream without a checkpoint must be rejected")
