"""Table contracts: raw landed tickets, clean tickets, column lists."""

from pyspark.sql import types as T

# The 14 columns selected from the source, in source order.
RAW_COLUMNS = [
    "unique_key", "created_date", "closed_date", "resolution_action_updated_date",
    "agency", "complaint_type", "descriptor", "status", "borough", "incident_zip",
    "city", "open_data_channel_type", "latitude", "longitude",
]

TIMESTAMP_COLUMNS = ["created_date", "closed_date", "resolution_action_updated_date"]
NUMERIC_COLUMNS = ["latitude", "longitude"]

# Text columns that are cast to string and stripped, in this order.
TEXT_COLUMNS = [
    "borough", "complaint_type", "descriptor", "status", "agency",
    "open_data_channel_type", "city", "incident_zip",
]

# Compact clean projection, in this order; absent columns are skipped.
CLEAN_COLUMNS = [
    "unique_key", "created_dt", "date", "hour", "day_of_week", "dow_name", "month", "month_name",
    "is_holiday", "borough", "complaint_type", "descriptor", "agency", "status",
    "open_data_channel_type", "response_hours", "within_sla", "latitude", "longitude",
    "incident_zip", "city",
]

# Columns every clean table must carry.
REQUIRED_COLUMNS = [
    "unique_key", "created_dt", "borough", "complaint_type", "descriptor",
    "response_hours", "within_sla", "hour", "dow_name", "month_name",
]

# Default columns of the data-sample grid.
SAMPLE_COLUMNS = list(REQUIRED_COLUMNS)


def _raw_type(name: str) -> T.DataType:
    if name in TIMESTAMP_COLUMNS:
        return T.TimestampNTZType()
    if name in NUMERIC_COLUMNS:
        return T.DoubleType()
    return T.StringType()


RAW_SCHEMA = T.StructType([T.StructField(c, _raw_type(c), True) for c in RAW_COLUMNS])
"""Typed raw ticket contract (after lenient parsing)."""

_CLEAN_TYPES = {
    "created_dt": T.TimestampNTZType(), "date": T.DateType(), "hour": T.IntegerType(),
    "day_of_week": T.IntegerType(), "month": T.IntegerType(), "is_holiday": T.BooleanType(),
    "response_hours": T.DoubleType(), "within_sla": T.BooleanType(),
    "latitude": T.DoubleType(), "longitude": T.DoubleType(),
}

CLEAN_SCHEMA = T.StructType([T.StructField(c, _CLEAN_TYPES.get(c, T.StringType())) for c in CLEAN_COLUMNS])
