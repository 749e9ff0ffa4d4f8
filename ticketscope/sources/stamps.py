"""Stamps: which state of the clean table a summary was built from.

The stamp of a month is a digest of the names and sizes of its data files. Spark never changes a
file in place and gives every file a fresh name, so a month that was written again has another
stamp, and listing the files is all it takes to see it. A table without month folders has one stamp,
under month ``None``.

Stamps are listed *before* the table is read for a summary: if the table changes meanwhile, the
summary counts as old.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import SparkSession

from ticketscope.sources.files import _fs_and_path, exists

Month = tuple[int, int] | None
STAMPS = "stamps"
_FOLDER = re.compile(r"/year=(\d+)/month=(\d+)/[^/]+$")


def month_stamps(spark: SparkSession, table: str) -> dict[Month, str]:
    """The stamp of each month of a clean table."""
    fs, root = _fs_and_path(spark, table)
    found: dict[Month, list[str]] = defaultdict(list)
    if not fs.exists(root):
        return {}
    listing = fs.listFiles(root, True)
    while listing.hasNext():
        info = listing.next()
        name = info.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        at = _FOLDER.search(info.getPath().toString())
        found[(int(at[1]), int(at[2])) if at else None].append(f"{name}:{info.getLen()}")
    return {month: hashlib.md5("\n".join(sorted(names)).encode()).hexdigest() for month, names in found.items()}


def write_stamps(spark: SparkSession, out_dir: str, stamps: dict[Month, str], sla_hours: float) -> None:
    rows = [(*(month or (None, None)), stamp, float(sla_hours)) for month, stamp in sorted(stamps.items(), key=str)]
    (spark.createDataFrame(rows, "year int, month int, stamp string, sla_hours double").coalesce(1)
     .write.mode("overwrite").parquet(f"{out_dir}/{STAMPS}"))


def read_stamps(spark: SparkSession, out_dir: str) -> tuple[dict[Month, str], float | None]:
    """The stamps that the summaries below `out_dir` were built from, and their SLA (one row per month)."""
    if not exists(spark, f"{out_dir}/{STAMPS}"):
        return {}, None
    rows = spark.read.schema("year int, month int, stamp string, sla_hours double").parquet(f"{out_dir}/{STAMPS}").collect()
    return ({(r.year, r.month) if r.year is not None else None: r.stamp for r in rows},
            rows[0].sla_hours if rows else None)


def changed_months(old: dict[Month, str], new: dict[Month, str]) -> set[Month]:
    """Months that were added, written again or removed."""
    return {m for m in old.keys() | new.keys() if old.get(m) != new.get(m)}
