"""Raw pages of any writer as Spark scans, by a catalogue of their footers.

Tasks read the footer of every file, nothing else, and give (path, layout): the Parquet types of the
contract columns. Files of one layout form a group; Spark infers the schema of one of them and scans
them all with it, cast to the contract; the groups are unioned by name. So filters and column lists
reach every file, large files are split, and no column is lost because another file lacks it.

The paths come to the driver, as they do in every file scan of Spark. In a store that pyarrow
doesn't know Spark infers the schema of each file instead (a small job a file).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.functions.time import utc_clock
from ticketscope.schema import NUMERIC_COLUMNS, RAW_SCHEMA, TIMESTAMP_COLUMNS

UNKNOWN_STORE = "?"
_NULL = "Null"
_NANOS = "timeUnit=nanoseconds"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def layout_of(footer: pq.FileMetaData, columns: list[str]) -> str:
    """The names, physical and logical types of the given columns that a file has."""
    schema = footer.schema
    out = []
    for i in range(len(schema)):
        c = schema.column(i)
        if c.path in columns:
            out.append(f"{c.path}={c.physical_type}/{c.logical_type}")
    return ";".join(sorted(out))


def _read_footers(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, layouts = b.column(0).to_pylist(), []
        for path in paths:
            try:
                system, name = _open(path)
            except (pa.ArrowInvalid, NotImplementedError):
                layouts.append(UNKNOWN_STORE)
                continue
            with system.open_input_file(name) as f:
                layouts.append(layout_of(pq.ParquetFile(f).metadata, columns))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(layouts, pa.string())], names=["path", "layout"])


def catalogue(spark: SparkSession, *roots: str, columns: list[str] | None = None) -> DataFrame:
    """(path, layout) of every Parquet file below the roots."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(list(roots)).select("path"))
    return listed.mapInArrow(partial(_read_footers, columns=columns or RAW_SCHEMA.names), "path string, layout string")


def _as_contract(name: str, wanted: T.DataType, found: T.DataType) -> Column:
    """A column of a file as the contract has it. What can't be read becomes null."""
    c = F.col(name)
    if found == wanted:
        return c
    if name in TIMESTAMP_COLUMNS:
        if isinstance(found, T.TimestampType):
            return utc_clock(c)
        if isinstance(found, T.DateType):
            return c.cast("timestamp_ntz")
        if isinstance(found, T.LongType):  # nanoseconds since 1970
            return utc_clock(F.timestamp_micros(F.expr(f"({name} - pmod({name}, 1000)) div 1000")))
        if isinstance(found, T.StringType):
            return c.try_cast("timestamp_ntz")
        return F.lit(None).cast("timestamp_ntz")
    if name in NUMERIC_COLUMNS:
        return c.try_cast("double") if isinstance(found, T.StringType) else c.cast("double")
    return c.cast("string")


def _scan(spark: SparkSession, paths: list[str], layout: str) -> DataFrame:
    """The files of one layout as contract rows."""
    nulls = {part.split("=")[0] for part in layout.split(";") if part.endswith("/" + _NULL)}
    reader = spark.read.option("recursiveFileLookup", "true")
    found = {f.name: f for f in reader.parquet(paths[0]).schema if f.name in RAW_SCHEMA.names and f.name not in nulls}
    scan = reader.schema(T.StructType(list(found.values()))).parquet(*paths)
    return scan.select(*[
        (_as_contract(f.name, f.dataType, found[f.name].dataType) if f.name in found else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in RAW_SCHEMA])


def read_pages(spark: SparkSession, *roots: str) -> DataFrame:
    """All pages below the roots as one contract table."""
    groups: dict[str, list[str]] = defaultdict(list)
    for path, layout in catalogue(spark, *roots).orderBy("path").toLocalIterator():
        groups[layout if layout != UNKNOWN_STORE else f"{UNKNOWN_STORE}{path}"].append(path)
    # Spark refuses nanosecond timestamps unless it may read them as longs. Groups that have them are
    # scanned by a session of their own, so that the caller's settings stay as they are.
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    out = spark.createDataFrame([], RAW_SCHEMA)
    for layout, paths in sorted(groups.items()):
        out = out.unionByName(_scan(own if _NANOS in layout else spark, paths, layout))
    return out
