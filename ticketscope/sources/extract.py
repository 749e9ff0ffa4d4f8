"""Raw-ticket extract: window, lenient parsing, bounded extract, paged sink, raw scans.

The window predicate and column list of an extract are pushed into the scan of a
landed dump, the optional row cap is an ordered prefix, and the sink writes exact
pages of ``page_size`` rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.operators.filters import ntz_literal
from ticketscope.operators.sampling import first_rows
from ticketscope.schema import NUMERIC_COLUMNS, RAW_COLUMNS, RAW_SCHEMA, TIMESTAMP_COLUMNS
from ticketscope.sources import catalogue, files, paging

DAYS_PER_YEAR = 365


class ExtractError(ValueError):
    pass


def as_date(value: str | dt.date) -> dt.date:
    """A date, or the ISO text of one."""
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(value) if len(value) == 10 else dt.date.fromisoformat("")
    except ValueError:
        raise ExtractError(f"{value!r} is no date of the form 2024-01-31") from None


def resolve_window(since: str | None = None, until: str | None = None,
                   env: dict | None = None, years_back: int = 5,
                   today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Both bounds, each the first that is given of: the argument, the setting
    (``SINCE_DATE``, ``UNTIL_DATE``), the default. The defaults are today and
    ``YEARS_BACK`` (else ``years_back``) years of 365 days before today."""
    settings = env or {}
    last = today or dt.date.today()
    first = last - dt.timedelta(days=DAYS_PER_YEAR * int(settings.get("YEARS_BACK") or years_back))
    asked = ((since, "SINCE_DATE", first), (until, "UNTIL_DATE", last))
    lower, upper = (as_date(next(v for v in (given, settings.get(name), default) if v)) for given, name, default in asked)
    if lower > upper:
        raise ExtractError(f"the window ends ({upper}) before it begins ({lower})")
    return lower, upper


def parse_landed(df: DataFrame) -> DataFrame:
    """Lenient typing of landed text: bad timestamps / numbers become null (ANSI-safe)."""
    kinds = dict.fromkeys(TIMESTAMP_COLUMNS, "timestamp_ntz") | dict.fromkeys(NUMERIC_COLUMNS, "double")
    return df.select(*[F.col(c).cast("string").try_cast(kinds[c]).alias(c) if c in kinds else F.col(c)
                       for c in df.columns])


def window_predicate(since: dt.date, until: dt.date, col: str = "created_date"):
    """Whole days ``since`` … ``until`` inclusive, as a half-open NTZ range."""
    return ((F.col(col) >= ntz_literal(since))
            & (F.col(col) < ntz_literal(until + dt.timedelta(days=1))))


def extract(df: DataFrame, since: dt.date | str, until: dt.date | str,
            limit: int | None = None) -> DataFrame:
    """The 14 contract columns of tickets created in the window; with ``limit`` the
    first ``limit`` by creation time (key as tie-break). ``0``/``None`` = no cap."""
    cols = [c for c in RAW_COLUMNS if c in df.columns]
    out = df.select(*cols).where(window_predicate(as_date(since), as_date(until)))
    if limit:
        out = first_rows(out, int(limit), F.to_date("created_date"), [F.col("created_date"), F.col("unique_key")])
    return out


def extract_plan(df: DataFrame, since, until, page_size: int = 50000,
                 limit: int | None = None) -> DataFrame:
    """What an extract would fetch: rows in the window, rows to fetch and pages of
    ``page_size``. With ``limit`` nothing is counted: the rows in the window stay
    unknown (null) and the limit is what would be fetched at most."""
    if limit:
        rows = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("rows_in_window"),
                                               F.lit(int(limit)).cast("long").alias("rows_to_fetch"))
    else:
        rows = (df.where(window_predicate(as_date(since), as_date(until)))
                .agg(F.count(F.lit(1)).alias("rows_in_window"))
                .withColumn("rows_to_fetch", F.col("rows_in_window")))
    pages = F.ceil(F.col("rows_to_fetch") / F.lit(float(page_size))).cast("long")
    return rows.withColumn("pages", pages)


def raw_folder(out_dir: str, since: dt.date) -> str:
    """The folder of the window that begins at ``since``."""
    return f"{out_dir}/since={since.isoformat()}"


def dry_run(df: DataFrame, out_dir: str, since, until, page_size: int = 50000,
            limit: int | None = None) -> DataFrame:
    """``extract_plan`` with the folder that ``write_raw`` would fill. Writes nothing."""
    return extract_plan(df, since, until, page_size, limit).withColumn(
        "folder", F.lit(raw_folder(out_dir, as_date(since))))


def write_raw(df: DataFrame, out_dir: str, since: dt.date, page_size: int = 50000) -> str:
    """Write the extract as pages of ``page_size`` rows in order of creation (then key), one Parquet
    file a page and only the last not full, with the full raw contract schema. A window that is run
    again (same ``since``, a later end) replaces its pages; other windows are left alone."""
    path = raw_folder(out_dir, since)
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA])
    order = [F.col("created_date").asc_nulls_last(), F.col("unique_key").asc_nulls_last()]
    return paging.write_pages(typed, path, order, page_size)


def _check_files(spark: SparkSession, root: str) -> None:
    if not files.any_data_file(spark, root):
        raise ExtractError(f"{root} holds no Parquet pages; land an extract there first")


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All raw Parquet pages under ``root`` that ``write_raw`` wrote, with the contract schema
    (columns a file lacks read as null). No files is an error."""
    _check_files(spark, root)
    return spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(root)


def read_raw_mixed(spark: SparkSession, *roots: str) -> DataFrame:
    """Raw pages of any writer, each *file* with its own layout, as one contract table.

    A folder may mix layouts: absent or entirely null columns, text, nanosecond, zone-aware and
    date timestamps, numbers as text. Files of one layout are one Spark scan (``catalogue``).
    Unparseable text becomes null, absent columns are null, columns outside the contract are left
    out. No files is an error.
    """
    for root in roots:
        _check_files(spark, root)
    return catalogue.read_pages(spark, *roots)
