"""Data-quality gates on the clean table, as one report DataFrame.

Gates: required columns present, unique key unique, no negative response
hours, minimum row count. ``quality_report`` computes them from a table in one grouped
pass (duplicates are counted, never collected). ``WriteGates`` takes them while a table is
written: the write itself counts its rows, the negative hours and the rows that cleaning
left out, so only the keys are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.schema import REQUIRED_COLUMNS

REPORT_SCHEMA = T.StructType([
    T.StructField("gate", T.StringType(), False),
    T.StructField("violations", T.LongType(), False),
    T.StructField("ok", T.BooleanType(), False),
])


class QualityError(RuntimeError):
    pass


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def quality_report(df: DataFrame, min_rows: int = 1000,
                   required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Rows ``(gate, violations, ok)`` for ``required_columns`` (missing columns),
    ``unique_key`` (surplus duplicate rows), ``non_negative_hours`` (negative rows) and
    ``min_rows`` (rows short of the minimum).

    The row gates come from one pass: a per-key aggregate (map-side combined, so a
    hot duplicate key is pre-aggregated) rolled up to a single row.
    """
    spark: SparkSession = df.sparkSession
    missing = missing_columns(df, required)
    cols_gate = spark.createDataFrame([("required_columns", len(missing), not missing)],
                                      REPORT_SCHEMA)
    neg = (F.count_if(F.col("response_hours") < 0) if "response_hours" in df.columns
           else F.lit(0).cast("long"))
    if "unique_key" in df.columns:
        per_key = df.groupBy("unique_key").agg(F.count(F.lit(1)).alias("n"), neg.alias("neg"))
        totals = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("dups"))
    else:
        totals = df.agg(F.count(F.lit(1)).alias("rows"), neg.alias("neg"),
                        F.lit(-1).alias("dups"))
    return cols_gate.unionByName(totals.select(F.inline(_row_gates("rows", "neg", "dups", min_rows))))


def _row_gates(rows: str, neg: str, dups: str, min_rows: int):
    """The gates of one row of totals; less than 0 duplicates stand for a missing key column."""
    short = F.greatest(F.lit(min_rows) - F.col(rows), F.lit(0))
    return F.array(
        F.struct(F.lit("unique_key").alias("gate"),
                 F.when(F.col(dups) < 0, 1).otherwise(F.col(dups)).cast("long")
                 .alias("violations"), (F.col(dups) == 0).alias("ok")),
        F.struct(F.lit("non_negative_hours").alias("gate"),
                 F.col(neg).cast("long").alias("violations"), (F.col(neg) == 0).alias("ok")),
        F.struct(F.lit("min_rows").alias("gate"), short.cast("long").alias("violations"),
                 (F.col(rows) >= F.lit(min_rows)).alias("ok")))


class WriteGates:
    """The gates of a table, counted by the job that writes it.

    ``landed`` marks the raw rows, ``cleaned`` the rows that are written; ``report`` is asked
    for after the write. Reading, cleaning and writing are one stage without a shuffle, of
    which Spark counts every task once, also where a lost executor makes it run again.

    The report has the rows of ``quality_report`` and ``undated_rows``: the raw rows without a
    creation time, which cleaning leaves out. They fail the gate only beyond ``max_undated``
    (None: any number passes).
    """

    def __init__(self) -> None:
        self._raw, self._clean = Observation(), Observation()
        self._landed: DataFrame | None = None

    def landed(self, raw: DataFrame) -> DataFrame:
        self._landed = raw
        return raw.observe(self._raw, F.count_if(F.col("created_date").isNull()).alias("undated"))

    def cleaned(self, clean: DataFrame) -> DataFrame:
        neg = F.count_if(F.col("response_hours") < 0) if "response_hours" in clean.columns else F.sum(F.lit(0))
        return clean.observe(self._clean, F.count(F.lit(1)).alias("rows"), neg.alias("neg"))

    def report(self, written: DataFrame, min_rows: int = 0, max_undated: int | None = None,
               required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
        """The report on the table as written; of its columns only the keys are read."""
        spark = written.sparkSession
        # an input that is known to be empty is optimised away together with its counters
        undated = self._raw.get.get("undated")
        if undated is None:
            undated = self._landed.where(F.col("created_date").isNull()).count()
        counts = self._clean.get
        if "unique_key" in written.columns:
            per_key = written.groupBy("unique_key").agg(F.count(F.lit(1)).alias("n"))
            totals = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dups"))
        else:
            totals = spark.range(1).select(F.lit(-1).alias("dups"))
        totals = totals.select("dups", F.lit(counts.get("rows") or 0).alias("rows"), F.lit(counts.get("neg") or 0).alias("neg"))
        missing = missing_columns(written, required)
        known = spark.createDataFrame(
            [("required_columns", len(missing), not missing),
             ("undated_rows", undated, max_undated is None or undated <= max_undated)], REPORT_SCHEMA)
        return known.unionByName(totals.select(F.inline(_row_gates("rows", "neg", "dups", min_rows))))


def enforce(df: DataFrame, min_rows: int = 0) -> None:
    """Raise ``QualityError`` when any gate fails (before anything is written)."""
    enforce_report(quality_report(df, min_rows=min_rows))


def enforce_report(report: DataFrame) -> None:
    """Raise ``QualityError`` when a gate of the report has failed."""
    rep = report.where(~F.col("ok")).orderBy("gate").collect()
    if rep:
        raise QualityError("; ".join(f"{r.gate}: {r.violations}" for r in rep))
