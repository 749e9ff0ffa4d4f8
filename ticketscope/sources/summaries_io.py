"""Summary tables on storage: write the three summaries, read those that exist."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ticketscope.sources import files

SUMMARY_NAMES = ("daily", "complaint_type", "dow_hour")
RUNS = "response_runs"


def write_summaries(summaries: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    paths = {}
    for name, df in summaries.items():
        p = os.path.join(out_dir, f"{name}_summary")
        df.write.mode("overwrite").parquet(p)
        paths[name] = p
    return paths


def read_summaries(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """Each summary that exists under ``out_dir``; missing ones are skipped. A daily summary kept in
    month folders reads like one that is not; ``runs`` are the response runs of ``plans.upkeep``."""
    out = {}
    for name in SUMMARY_NAMES:
        p = os.path.join(out_dir, f"{name}_summary")
        if files.any_data_file(spark, p):
            out[name] = spark.read.parquet(p).drop("year", "month")
    p = os.path.join(out_dir, RUNS)
    if files.any_data_file(spark, p):
        out["runs"] = spark.read.parquet(p)
    return out
