import datetime as dt
import glob
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import SF001
from helpers import edge_raw
from ticketscope.operators.clean import clean
from ticketscope.operators.filters import TicketFilter
from ticketscope.sources import csv_export as CSV
from ticketscope.sources import extract as E
from ticketscope.sources import fixtures as FX
from ticketscope.sources import storage as ST
from ticketscope.sources import summaries_io as SIO
from ticketscope.operators import summaries as SM
from ticketscope.operators import exports as EX


def test_extract_limit_writes_pages_of_page_size(spark, tmp_dir):
    """Limit 5 with 3 rows per page gives two files of 3 and 2 rows with typed columns."""
    raw = FX.raw_tickets_a(spark, SF001)
    out = E.write_raw(E.extract(raw, "2024-01-01", "2024-01-31", limit=5), tmp_dir,
                      dt.date(2024, 1, 1), page_size=3)
    files = sorted(glob.glob(os.path.join(out, "*.parquet")))
    sizes = sorted(pq.ParquetFile(f).metadata.num_rows for f in files)
    assert sizes == [2, 3]
    back = E.read_raw(spark, tmp_dir)
    assert dict(back.dtypes)["created_date"] == "timestamp_ntz"
    assert dict(back.dtypes)["latitude"] == "double"
    first = raw.orderBy("created_date", "unique_key").limit(5).select("unique_key")
    assert sorted(r[0] for r in back.select("unique_key").collect()) == \
        sorted(r[0] for r in first.collect())


def test_a_window_run_again_replaces_its_pages_only(spark, tmp_dir):
    raw = FX.raw_tickets_a(spark, SF001)
    E.write_raw(E.extract(raw, "2024-01-10", "2024-01-12"), tmp_dir, dt.date(2024, 1, 10))
    E.write_raw(E.extract(raw, "2024-01-01", "2024-01-02"), tmp_dir, dt.date(2024, 1, 1))
    E.write_raw(E.extract(raw, "2024-01-01", "2024-01-05"), tmp_dir, dt.date(2024, 1, 1))
    want = E.extract(raw, "2024-01-10", "2024-01-12").count() + E.extract(raw, "2024-01-01", "2024-01-05").count()
    assert E.read_raw(spark, tmp_dir).count() == want


def test_dry_run_reports_and_writes_nothing(spark, tmp_dir):
    raw = FX.raw_tickets_a(spark, SF001)
    r = E.dry_run(raw, tmp_dir, "2024-01-01", "2024-01-02", page_size=10).first()
    assert r.rows_in_window == E.extract(raw, "2024-01-01", "2024-01-02").count()
    assert r.pages == -(-r.rows_in_window // 10) and r.folder.endswith("since=2024-01-01")
    assert not os.listdir(tmp_dir)


def test_read_raw_without_files_raises(spark, tmp_dir):
    with pytest.raises(E.ExtractError):
        E.read_raw(spark, tmp_dir)


def test_window_resolution():
    today = dt.date(2025, 6, 30)
    assert E.resolve_window("2024-01-01", "2024-12-31") == (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert E.resolve_window(env={"SINCE_DATE": "2023-05-01"}, today=today) == \
        (dt.date(2023, 5, 1), today)
    assert E.resolve_window(env={"YEARS_BACK": "2"}, today=today)[0] == today - dt.timedelta(730)
    with pytest.raises(E.ExtractError):
        E.resolve_window("2024-02-01", "2024-01-01")
    with pytest.raises(E.ExtractError):
        E.resolve_window("2024/01/01")


def test_extract_plan_pages(spark):
    raw = FX.raw_tickets_a(spark, SF001)
    r = E.extract_plan(raw, "2024-01-01", "2024-01-31", page_size=123).first()
    assert r.rows_in_window == raw.count() and r.pages == -(-r.rows_in_window // 123)
    r2 = E.extract_plan(raw, "2024-01-01", "2024-01-31", page_size=123, limit=5).first()
    assert (r2.rows_in_window, r2.rows_to_fetch, r2.pages) == (None, 5, 1)     # nothing is counted


def test_foreign_pages_with_null_typed_and_missing_columns(spark, tmp_dir):
    """Pages written by pandas: an all-null column stored as int, nanosecond-free timestamps."""
    a = os.path.join(tmp_dir, "a")
    b = os.path.join(tmp_dir, "b")
    os.makedirs(a)
    os.makedirs(b)
    pq.write_table(pa.table({
        "unique_key": ["k1"], "created_date": pa.array([pd.Timestamp("2025-01-01")], pa.timestamp("us")),
        "city": pa.array([None], pa.int32()), "latitude": ["40.0"]}), os.path.join(a, "p1.parquet"))
    pq.write_table(pa.table({
        "unique_key": ["k2"], "created_date": pa.array([pd.Timestamp("2025-01-02")], pa.timestamp("us")),
        "city": ["queens"], "borough": ["QUEENS"], "latitude": [40.5]}), os.path.join(b, "p1.parquet"))
    df = E.read_raw_mixed(spark, a, b)
    assert df.count() == 2
    got = {r.unique_key: r for r in df.collect()}
    assert got["k1"].city is None and got["k1"].latitude == 40.0 and got["k1"].borough is None
    assert got["k2"].city == "queens"


def scanned_files(df):
    """Files the executed scan actually read (from its metrics)."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numFiles"):
            total += m.apply("numFiles").value()
    return total


def test_partitioned_write_prunes_and_overwrites_dynamically(spark, tmp_dir):
    c = clean(FX.raw_tickets_b(spark, SF001))
    ST.write_clean_partitioned(c, tmp_dir)
    assert glob.glob(os.path.join(tmp_dir, "year=*", "month=*", "*.parquet"))
    flt = TicketFilter(start="1996-03-01", end="1996-04-30")
    q = ST.scan_filtered(spark, tmp_dir, flt)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "month" in plan
    assert "PushedFilters: [IsNotNull(created_dt), GreaterThanOrEqual(created_dt" in plan
    n = len(q.collect())
    assert n == flt.apply(c).count()
    assert scanned_files(q) == len(glob.glob(os.path.join(tmp_dir, "year=1996", "month=[34]",
                                                          "*.parquet")))
    # rewriting one month replaces only that month
    before = ST.read_clean(spark, tmp_dir).count()
    one = c.where((F.year("created_dt") == 1996) & (F.month("created_dt") == 3))
    ST.write_clean_partitioned(one, tmp_dir)
    assert ST.read_clean(spark, tmp_dir).count() == before


def test_read_tickets_prefers_partitioned_copy(spark, tmp_dir):
    c = clean(edge_raw(spark))
    ST.write_clean(c, os.path.join(tmp_dir, ST.SINGLE))
    assert "year" not in ST.read_tickets(spark, tmp_dir).columns
    ST.write_clean_partitioned(c, os.path.join(tmp_dir, ST.PARTITIONED))
    df = ST.read_tickets(spark, tmp_dir)
    assert "year" in df.columns and spark.table("tickets").count() == c.count()


def test_summaries_and_csv_roundtrip(spark, tmp_dir):
    c = clean(FX.raw_tickets_a(spark, SF001))
    daily = SM.daily_summary(c)
    SIO.write_summaries({"daily": daily}, tmp_dir)
    got = SIO.read_summaries(spark, tmp_dir)
    assert set(got) == {"daily"} and got["daily"].count() == daily.count()
    ex = EX.export_type_breaches(c)
    path = CSV.write_csv(ex, tmp_dir, "type_breaches")
    assert os.path.basename(path).startswith("type_breaches_")
    assert len(glob.glob(os.path.join(path, "*.csv"))) == 1
    back = CSV.read_csv(spark, path, ex.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, ex.collect()), key=str)


def test_foreign_pages_with_nanosecond_and_zoned_timestamps(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "ns"), os.path.join(tmp_dir, "tz")
    os.makedirs(a)
    os.makedirs(b)
    pq.write_table(pa.table({
        "unique_key": ["n1", "n2"],
        "created_date": pa.array([pd.Timestamp("2025-01-01 10:00:00.123456789"), None],
                                 pa.timestamp("ns"))}), os.path.join(a, "p.parquet"), version="2.6")
    pq.write_table(pa.table({
        "unique_key": ["z1"],
        "created_date": pa.array([pd.Timestamp("2025-01-01 10:00:00", tz="America/New_York")],
                                 pa.timestamp("us", tz="America/New_York"))}),
        os.path.join(b, "p.parquet"))
    got = {r.unique_key: r.created_date for r in E.read_raw_mixed(spark, a, b).collect()}
    assert got["n1"] == dt.datetime(2025, 1, 1, 10, 0, 0, 123456)
    assert got["n2"] is None
    assert got["z1"] == dt.datetime(2025, 1, 1, 15, 0, 0)          # the instant's UTC wall clock


def test_one_folder_of_files_with_different_columns(spark, tmp_dir):
    """A file lacks columns that another has: nothing is dropped, and whole microseconds stay whole."""
    times = [pd.Timestamp("1969-12-31 23:59:59.999999") + pd.Timedelta(microseconds=997 * i) for i in range(500)]
    pq.write_table(pa.table({"unique_key": ["a"], "created_date": ["2025-01-01T10:00:00"]}), os.path.join(tmp_dir, "a.parquet"))
    pq.write_table(pa.table({"unique_key": [f"b{i}" for i in range(500)], "created_date": pa.array(times, pa.timestamp("ns")),
                             "borough": ["BRONX"] * 500, "city": pa.array(["NYC"] * 500).dictionary_encode(),
                             "incident_zip": [10001] * 500, "other": [1] * 500}),
                   os.path.join(tmp_dir, "b.parquet"), version="2.6")
    got = {r.unique_key: r for r in E.read_raw_mixed(spark, tmp_dir).collect()}
    assert got["a"].created_date == dt.datetime(2025, 1, 1, 10) and got["a"].borough is None
    assert all(got[f"b{i}"].created_date == t.to_pydatetime() for i, t in enumerate(times))
    assert {(r.borough, r.city, r.incident_zip) for k, r in got.items() if k != "a"} == {("BRONX", "NYC", "10001")}


def test_replace_dir_swaps(spark, tmp_dir):
    from ticketscope.sources import files
    for name in ("old", "new"):
        os.makedirs(f"{tmp_dir}/{name}")
        open(f"{tmp_dir}/{name}/{name}.txt", "w").close()
    files.replace_dir(spark, f"{tmp_dir}/new", f"{tmp_dir}/old")
    assert os.listdir(tmp_dir) == ["old"] and os.listdir(f"{tmp_dir}/old") == ["new.txt"]
    with pytest.raises(OSError):
        files.replace_dir(spark, f"{tmp_dir}/missing", f"{tmp_dir}/old")
    assert os.listdir(f"{tmp_dir}/old") == ["new.txt"]          # a failed move leaves the table


def _pages(folder):
    return [pq.read_table(f) for f in sorted(glob.glob(os.path.join(folder, "*.parquet"))) if pq.ParquetFile(f).metadata.num_rows]


def test_pages_are_exact(spark, tmp_dir):
    raw = edge_raw(spark)
    n = raw.count()
    for size in (1, 3, 4, 100):
        pages = _pages(E.write_raw(raw, f"{tmp_dir}/{size}", dt.date(2024, 1, 1), page_size=size))
        assert [p.num_rows for p in pages] == [min(size, n - at) for at in range(0, n, size)]
        times = [(t is None, t, k) for p in pages for t, k in zip(p["created_date"].to_pylist(), p["unique_key"].to_pylist())]
        assert times == sorted(times, key=lambda x: (x[0], x[1] or dt.datetime.max, x[2]))
        assert E.extract_plan(raw, "1990-01-01", "2030-01-01", size).first().pages == -(-(n - 1) // size)  # one row has no creation time


def test_pages_of_equal_rows(spark, tmp_dir):
    rows = edge_raw(spark).limit(1).crossJoin(spark.range(1000)).drop("id")
    pages = _pages(E.write_raw(rows, tmp_dir, dt.date(2024, 1, 1), page_size=64))
    assert [p.num_rows for p in pages] == [64] * 15 + [1000 - 15 * 64]
    empty = E.write_raw(rows.limit(0), f"{tmp_dir}/none", dt.date(2024, 1, 1))
    assert spark.read.schema(E.RAW_SCHEMA).parquet(empty).count() == 0


def test_mixed_pages_are_scans(spark, tmp_dir):
    """Filters and column lists reach the files; footers alone are read before."""
    raw = edge_raw(spark)
    raw.write.parquet(f"{tmp_dir}/a")
    raw.drop("agency").withColumn("city", F.lit(None).cast("int")).write.parquet(f"{tmp_dir}/b")
    df = E.read_raw_mixed(spark, tmp_dir).where("borough = 'QUEENS'").select("unique_key")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(borough), EqualTo(borough,QUEENS)]") == 2 and "Python" not in plan and "Arrow" not in plan
    assert plan.count("ReadSchema: struct<unique_key:string,borough:string>") == plan.count("ReadSchema") == 2
    assert df.count() == 2 * raw.where("borough = 'QUEENS'").count()
