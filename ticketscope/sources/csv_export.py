"""CSV sinks for BI extracts and the current filtered view."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stamped_name(name: str, when: dt.datetime | None = None) -> str:
    return f"{name}_{(when or dt.datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_csv(df: DataFrame, out_dir: str, name: str, stamp: bool = True,
              when: dt.datetime | None = None) -> str:
    """One header CSV file per extract (extracts are small aggregates). The upstream
    aggregation stays parallel; only the final ordered rows are concatenated."""
    path = os.path.join(out_dir, stamped_name(name, when) if stamp else name)
    (df.coalesce(1).write.mode("errorifexists").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            .schema(schema).csv(path))


def write_view_csv(view: DataFrame, out_dir: str, name: str = "current_view",
                   columns: list[str] | None = None) -> str:
    """The current filtered view (e.g. ``sampling.sample_view``) with the chosen columns as a
    folder of header CSV files: one file of a limited view, as many as the view has
    partitions else. File names follow the view's order."""
    path = os.path.join(out_dir, stamped_name(name))
    (view.select(*(columns or view.columns)).write.mode("errorifexists").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path
