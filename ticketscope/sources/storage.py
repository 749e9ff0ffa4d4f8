"""Clean-table storage: single dataset, year/month-partitioned dataset, scans.

The partitioned write rebalances rows by the partition keys with AQE
(``REBALANCE`` hint) so a busy month is split over several tasks and files
instead of landing in one task, and sorts rows by creation time inside each
file so Parquet min/max statistics let date filters skip row groups.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ticketscope.operators.clean import with_partition_keys
from ticketscope.operators.filters import TicketFilter
from ticketscope.schema import CLEAN_SCHEMA
from ticketscope.sources import files

PARTITIONED = "processed_part"
SINGLE = "processed/clean.parquet"


def write_clean(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_clean_partitioned(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> str:
    """Partition by ``year``/``month``; only the partitions present in ``df`` are replaced
    (dynamic partition overwrite). Failures raise."""
    keyed = with_partition_keys(df) if "year" not in df.columns else df
    (keyed.hint("rebalance", "year", "month")
     .sortWithinPartitions("year", "month", "created_dt")
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", int(max_records_per_file))
     .partitionBy("year", "month")
     .parquet(path))
    return path


def read_clean(spark: SparkSession, path: str,
               schema: T.StructType | None = None) -> DataFrame:
    """Scan a clean dataset; a partitioned one exposes ``year``/``month`` columns. With the
    contract ``schema`` no footer-inference job runs."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


PARTITIONED_SCHEMA = T.StructType(list(CLEAN_SCHEMA.fields)
                                  + [T.StructField("year", T.IntegerType())])


def read_tickets(spark: SparkSession, root: str, view: str | None = "tickets") -> DataFrame:
    """The clean table under ``root`` with its contract schema: the partitioned copy when
    present, else the single dataset; optionally registered as a temporary view."""
    part = os.path.join(root, PARTITIONED)
    if files.exists(spark, part):
        df = read_clean(spark, part, PARTITIONED_SCHEMA)
    else:
        df = read_clean(spark, os.path.join(root, SINGLE), CLEAN_SCHEMA)
    if view:
        df.createOrReplaceTempView(view)
    return df


def scan_filtered(spark: SparkSession, path: str, flt: TicketFilter) -> DataFrame:
    """Filtered scan of a partitioned clean table: the date range also becomes a
    ``year``/``month`` predicate, so Spark lists and reads only matching folders."""
    return flt.apply(read_clean(spark, path))
