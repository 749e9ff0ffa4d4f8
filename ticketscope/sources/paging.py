"""Exact pages: page k holds the rows k * size to (k + 1) * size of an order, one file a page.

Rows are range-partitioned and sorted, and staged with their partition and their place in it (one
write, which also fixes the order of equal rows). The counts of the partitions, one row each, give
every partition's first position; position and page follow row by row. Rows are then dealt out by
ranges of pages, so a page is in one task and one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.session import scratch_dir, scratch_scope


def with_positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of `df` with `position`, from 0, in the given order; equal rows in any, but fixed,
    order. Backed by a scratch table."""
    spark = df.sparkSession
    keys = [*order, F.xxhash64(*df.columns)]  # the hash spreads rows of one key over partitions
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    staged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumns({"__part": F.spark_partition_id(), "__at": low}))
    path = scratch_dir(spark, "positions")
    staged.write.parquet(path)
    rows = spark.read.schema(staged.schema).parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = (rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (rows.join(starts, "__part").withColumn("position", F.col("__start") + F.col("__at"))
            .drop("__part", "__at", "__start"))


def write_pages(df: DataFrame, path: str, order: list[Column], page_size: int) -> str:
    """Write one file a page below `path`, in the order of their names, replacing what is there.

    Ranges of pages go to tasks, so a task begins with a page's first row and cuts its files every
    `page_size` rows: each file is one page."""
    size = int(page_size)
    if size < 1:
        raise ValueError(f"a page of {page_size} rows")
    with scratch_scope(df.sparkSession):
        rows = with_positions(df, order).withColumn("__page", F.floor(F.col("position") / F.lit(size)))
        (rows.repartitionByRange("__page").sortWithinPartitions("position").select(*df.columns)
         .write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", size).parquet(path))
    return path
