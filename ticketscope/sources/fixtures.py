"""Map the driver's benchmark tables onto the raw ticket contract.

Fixture A (``events`` ⋈ ``region``): one ticket per event, borough from the
region, open tickets, resolution-only tickets, messy text — rates, medians,
seasonality and clean-up.
Fixture B (``orders`` ⋈ ``lineitem``): multi-year tickets with negative
durations and duplicate keys — quality gates and partitioned storage.

Both are plain lazy joins; Catalyst prunes the scans to the columns used and
sizes the join strategy itself (``region`` is a five-row dimension).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Read contracts of the benchmark tables used here. An explicit schema skips the
# footer-inference job a bare ``spark.read.parquet`` launches for every table.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = TABLE_SCHEMAS.get(name)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


# The fixture text mapping ``events`` ⋈ ``region`` rows to raw tickets.
_END_A = "ts + make_dt_interval(0, 0, 0, cast(floor(value * 3600) as bigint))"
FIXTURE_A_COLUMNS = [
    "cast(event_id as string) as unique_key",
    "ts as created_date",
    f"case when event_id % 5 <> 0 then {_END_A} end as closed_date",
    f"case when event_id % 10 = 0 then {_END_A} end as resolution_action_updated_date",
    "concat('AG', cast(user_id % 3 as string)) as agency",
    "concat(event_type, ' ', cast(user_id % 4 as string)) as complaint_type",
    "event_type as descriptor",
    "case when event_id % 10 = 5 then 'Open' else ' Closed ' end as status",
    "r_name as borough",
    "lpad(cast(user_id as string), 5, '0') as incident_zip",
    "case when event_id % 4 <> 0 then concat('  o''brien ', lower(r_name), '-side ') end as city",
    "case when event_id % 2 = 0 then 'PHONE' else 'ONLINE' end as open_data_channel_type",
    "cast(40.5 as double) + (user_id % 100) / cast(200 as double) as latitude",
    "cast(-74.2 as double) + (event_id % 100) / cast(200 as double) as longitude",
]


def raw_tickets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A as typed raw tickets (14 columns, raw contract types)."""
    ev = table(spark, sf_dir, "events")
    rg = table(spark, sf_dir, "region")
    j = ev.join(rg, (ev["user_id"] % 5) == rg["r_regionkey"])
    return j.selectExpr(*FIXTURE_A_COLUMNS)


def raw_tickets_b(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Fixture B: order lines as tickets (negative durations, duplicate keys)."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    cols = [
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("unique_key"),
        F.col("o_orderdate").alias("created_date"),
        F.col("l_shipdate").alias("closed_date"),
        F.lit(None).cast("timestamp_ntz").alias("resolution_action_updated_date"),
        F.col("o_orderpriority").alias("complaint_type"),
        F.col("o_orderstatus").alias("status"),
    ]
    if full:
        cols += [F.lit(None).cast("string").alias(c) for c in
                 ("agency", "descriptor", "borough", "incident_zip", "city",
                  "open_data_channel_type")]
        cols += [F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")]
    return j.select(*cols)


# Nine tickets of ten in one hour, borough and complaint type, their response times kept.
_HOT = "cast(unique_key as bigint) % 10 <> 0"
_HOT_TIME = "timestamp_ntz '2024-01-10 15:00:00'"


def skewed_tickets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A with nine tenths of the tickets in one group of every grouping."""
    raw = raw_tickets_a(spark, sf_dir)
    own = {"created_date": _HOT_TIME, "borough": "'ASIA'", "complaint_type": "'click 0'"}
    own |= {c: f"{c} + ({_HOT_TIME} - created_date)" for c in ("closed_date", "resolution_action_updated_date")}
    return raw.selectExpr(*[f"case when {_HOT} then {own[c]} else {c} end as {c}" if c in own else c for c in raw.columns])


def _iso_text(ts):
    """ISO text of a zone-less timestamp (``2024-01-01T00:00:07.179575``), zone independent."""
    return F.regexp_replace(ts.cast("string"), " ", "T")


def landed_text_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A as landed text (every column a string), with unparseable values.

    Every 7th event carries a malformed creation time and every 9th a malformed
    latitude, as a real extract can contain.
    """
    raw = raw_tickets_a(spark, sf_dir)
    eid = F.col("unique_key").cast("bigint")
    out = []
    for c in raw.columns:
        v = F.col(c).cast("string")
        if c == "created_date":
            v = F.when(eid % 7 == 3, F.concat(F.lit("not a time "), F.col("unique_key"))).otherwise(
                _iso_text(F.col(c)))
        elif c in ("closed_date", "resolution_action_updated_date"):
            v = _iso_text(F.col(c))
        elif c == "latitude":
            v = F.when(eid % 9 == 4, F.lit("n/a")).otherwise(F.col(c).cast("string"))
        out.append(v.alias(c))
    return raw.select(*out)
