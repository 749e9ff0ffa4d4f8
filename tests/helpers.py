"""The test data's folders, and hand-made raw tickets covering the edge rows every operator must handle."""

import datetime as dt
import os

from ticketscope.schema import RAW_SCHEMA

HERE = os.path.dirname(os.path.abspath(__file__))
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def ts(s):
    return dt.datetime.fromisoformat(s)


def raw_row(key, created, closed=None, updated=None, borough="QUEENS", complaint="Noise",
            city="  flushing ", status="Closed", lat=40.7, lon=-73.8):
    return (key, ts(created) if created else None, ts(closed) if closed else None,
            ts(updated) if updated else None, "NYPD", complaint, "Loud", status, borough,
            "11354", city, "PHONE", lat, lon)


# created_date is UTC wall clock; local (New York) is 5 h earlier in winter.
EDGE_ROWS = [
    raw_row("open", "2024-01-10 15:00:00"),                                            # open ticket
    raw_row("at_sla", "2024-01-10 15:00:00", "2024-01-11 15:00:00"),                   # exactly 24 h
    raw_row("just_over", "2024-01-10 15:00:00", "2024-01-11 15:00:01"),                # breach
    raw_row("upd_only", "2024-01-10 15:00:00", None, "2024-01-10 18:30:00"),           # 3.5 h
    raw_row("null_boro", "2024-01-12 12:00:00", "2024-01-12 13:00:00", borough=None, city=None),
    raw_row("empty_boro", "2024-01-12 12:00:00", "2024-01-12 14:00:00", borough="", city=""),
    raw_row("null_type", "2024-01-12 12:00:00", "2024-01-12 15:00:00", complaint=None),
    raw_row("midnight", "2024-01-16 04:59:59", "2024-01-16 06:00:00"),                 # 23:59:59 local
    raw_row("holiday", "2024-01-15 17:00:00", "2024-01-15 18:00:00"),                  # MLK day
    raw_row("neg", "2024-01-20 12:00:00", "2024-01-19 12:00:00"),                      # negative
    raw_row("nocreate", None, "2024-01-19 12:00:00"),                                  # dropped
    raw_row("dup", "2024-01-21 12:00:00", "2024-01-21 13:00:00"),
    raw_row("dup", "2024-01-21 12:00:00", "2024-01-21 13:00:00"),
]


def edge_raw(spark):
    return spark.createDataFrame(EDGE_ROWS, RAW_SCHEMA)
