import datetime as dt

from pyspark.sql import functions as F

from helpers import edge_raw
from ticketscope.operators.clean import clean, rethreshold, with_partition_keys
from ticketscope.schema import CLEAN_SCHEMA, REQUIRED_COLUMNS
from ticketscope.sources.extract import parse_landed


def rows(df):
    return {r.unique_key: r for r in df.collect()}


def test_clean_schema_and_columns(spark):
    c = clean(edge_raw(spark))
    assert [f.name for f in c.schema] == [f.name for f in CLEAN_SCHEMA]
    assert {f.name: f.dataType for f in c.schema} == {f.name: f.dataType for f in CLEAN_SCHEMA}
    assert set(REQUIRED_COLUMNS) <= set(c.columns)


def test_edge_rows(spark):
    r = rows(clean(edge_raw(spark)))
    assert "nocreate" not in r                                     # no creation time: dropped
    assert r["open"].response_hours is None and r["open"].within_sla is False
    assert r["at_sla"].response_hours == 24.0 and r["at_sla"].within_sla is True
    assert r["just_over"].within_sla is False
    assert r["upd_only"].response_hours == 3.5                     # resolution update as end
    assert r["neg"].response_hours == -24.0
    m = r["midnight"]                                              # 04:59:59 UTC = 23:59:59 NY
    assert (m.created_dt, m.date, m.hour) == (dt.datetime(2024, 1, 15, 23, 59, 59),
                                              dt.date(2024, 1, 15), 23)
    assert m.dow_name == "Monday" and m.day_of_week == 0 and m.month_name == "January"
    assert r["holiday"].is_holiday is True and r["at_sla"].is_holiday is False
    assert r["null_boro"].city == "Unknown"                        # city and borough null
    assert r["empty_boro"].city == ""                              # empty string is kept
    assert r["open"].city == "Flushing"
    assert r["at_sla"].status == "Closed"


def test_city_falls_back_to_borough(spark):
    from helpers import raw_row
    from ticketscope.schema import RAW_SCHEMA
    df = spark.createDataFrame([raw_row("k", "2024-01-10 15:00:00", borough=" staten island ",
                                        city=None)], RAW_SCHEMA)
    assert clean(df).first().city == "Staten Island"


def test_missing_raw_columns_are_skipped(spark):
    raw = edge_raw(spark).drop("city", "descriptor", "resolution_action_updated_date")
    c = clean(raw)
    assert "city" not in c.columns and "descriptor" not in c.columns
    assert rows(c)["upd_only"].response_hours is None


def test_rethreshold_and_partition_keys(spark):
    c = rethreshold(clean(edge_raw(spark)), 48.0)
    r = rows(c)
    assert r["just_over"].within_sla is True and r["just_over"].breach is False
    assert r["open"].breach is True
    p = rows(with_partition_keys(clean(edge_raw(spark))))
    assert (p["midnight"].year, p["midnight"].month) == (2024, 1)


def test_lenient_parse(spark):
    df = spark.createDataFrame(
        [("a", "2025-01-01T00:00:00", "not a date", None, "40.0", "x"),
         ("b", "garbage", "2025-01-02 10:00:00", "2025-01-02", "", "-73.5")],
        "unique_key string, created_date string, closed_date string, "
        "resolution_action_updated_date string, latitude string, longitude string")
    out = rows(parse_landed(df))
    assert out["a"].created_date == dt.datetime(2025, 1, 1) and out["a"].closed_date is None
    assert out["a"].latitude == 40.0 and out["a"].longitude is None
    assert out["b"].created_date is None and out["b"].longitude == -73.5
    assert out["b"].resolution_action_updated_date == dt.datetime(2025, 1, 2)


def test_zone_aware_input_is_only_converted(spark):
    from ticketscope.functions.time import to_local
    from pyspark.sql import types as T
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12, 0),)], "t timestamp_ntz")
    ltz = df.select(F.col("t").cast("timestamp").alias("t"))   # session zone is UTC
    got = ltz.select(to_local("t", data_type=T.TimestampType()).alias("l")).first().l
    assert got == dt.datetime(2024, 7, 1, 8, 0)
