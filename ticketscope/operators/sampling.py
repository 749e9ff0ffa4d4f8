"""Ordered prefixes, the sample grid and random samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.functions import sla as S
from ticketscope.operators.filters import TicketFilter
from ticketscope.schema import SAMPLE_COLUMNS


def first_rows(df: DataFrame, n: int, coarse: Column, order: list[Column]) -> DataFrame:
    """The first ``n`` rows by ``order`` (all of them if there are fewer).

    ``coarse`` is a step function of the order (rows of a smaller step come first,
    null steps last) with a bounded number of steps, such as the day of a time.
    Rows are counted per step, the step that holds row ``n`` is found from the
    running count (one row to the driver), and only rows up to it are sorted. So
    the sort meets about ``n`` rows plus those of one step, however large the table
    is, and the literal bound reaches the scan where the step allows it.
    """
    steps = df.select(coarse.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(F.col("step").asc_nulls_last()))
    last = (steps.withColumn("upto", upto).where((F.col("upto") >= int(n)) & F.col("step").isNotNull())
            .agg(F.min("step")).first()[0])
    near = df if last is None else df.where(coarse <= F.lit(last))
    return near.orderBy(*order).limit(int(n))


def sample_view(clean_df: DataFrame, flt: TicketFilter | None = None, limit: int = 20000,
                sla_hours: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """First ``limit`` filtered tickets in creation order (repeatable), with optional
    re-thresholded ``within_sla``/``breach`` for the current SLA, projected to ``columns``."""
    d = (flt or TicketFilter()).apply(clean_df)
    if sla_hours is not None:
        d = d.withColumn("within_sla", S.within_sla("response_hours", sla_hours)) \
             .withColumn("breach", ~F.col("within_sla"))
    d = first_rows(d, limit, F.to_date("created_dt"),
                   [F.col("created_dt").asc_nulls_last(), F.col("unique_key").asc_nulls_last()])
    return d if columns is None else d.select(*columns)


def sample_columns(available: list[str], chosen: list[str] | None = None) -> list[str]:
    """User column choice, defaulting to the ten-column grid; unknown names rejected."""
    cols = list(chosen) if chosen else [c for c in SAMPLE_COLUMNS if c in available]
    missing = [c for c in cols if c not in available]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return cols


def random_sample(df: DataFrame, n: int = 50000, seed: int = 42, key: str = "unique_key") -> DataFrame:
    """Uniform random ``n``-row sample (all rows when fewer): the ``n`` rows with the smallest
    ``md5(seed:key)``. It depends on the rows, the seed and nothing else: neither the file layout
    nor a retried task changes it. Rows that share a key are ordered by their other columns."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    keyed = df.withColumn("__r", mark)
    out = first_rows(keyed, n, F.substring("__r", 1, 4),
                     [F.col("__r"), *[F.col(c).asc_nulls_last() for c in df.columns]])
    return out.drop("__r")


def write_sample(spark: SparkSession, root: str, path: str, n: int = 50000, seed: int = 42) -> str:
    """A random sample of the stored clean table, written as Parquet."""
    from ticketscope.sources import storage

    random_sample(storage.read_tickets(spark, root, view=None), n, seed).write.mode("overwrite").parquet(path)
    return path
