"""Incremental clean-table refresh with Structured Streaming.

New raw pages landing under ``raw_dir`` are picked up by the file source, cleaned
with the same expressions as the batch job and merged by ``unique_key`` into the
year/month partitioned clean table: only the months that the new tickets touch, or
that hold an earlier row of one of their keys, are read and replaced, and of rows with
one key that with the latest end stays. So a ticket that landed open and again once
closed becomes closed, one whose creation time was corrected moves to its month, a page
of any age counts, and a batch that is run again after a failure changes nothing.

**Where the keys are.** Beside the table lies an index (``_keys``): the unique keys of every
month with the month's stamp, so a batch finds the months of its keys without reading the
tickets. A month whose stamp doesn't agree (it was written since, by a merge or the batch job)
is indexed again.

**Publishing can be finished or undone.** The merged months are staged beside the table
(``_journal``), whole, before any is replaced; a marker says that the staging is complete. A
run that finds a journal with the marker publishes what it holds (again, if need be: replacing
a month twice is the same as once); without the marker the table is still the old one and the
journal is deleted. So a failure between two months loses no row.

Run with ``availableNow`` from a scheduler (each run processes what has landed since
the last one, then stops) or continuously. Progress lives in the checkpoint folder,
which belongs to one output folder and must be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketscope.operators.clean import clean, with_partition_keys
from ticketscope.schema import RAW_SCHEMA
from ticketscope.sources import files, stamps, storage

JOURNAL, KEYS, COMPLETE = "_journal", "_keys", "_complete"
_KEY_SCHEMA = "unique_key string, stamp string, year int, month int"


def latest_per_key(rows: DataFrame) -> DataFrame:
    """One row per ``unique_key``: that with the latest end (open last), then the smallest of its
    other columns, so the choice never depends on row order. Rows without a key can't be
    merged; equal ones among them are one."""
    end = F.timestamp_add("MICROSECOND", (F.col("response_hours") * 3.6e9).cast("bigint"), F.col("created_dt"))
    others = [F.col(c).asc_nulls_last() for c in rows.columns if c != "unique_key"]
    best = Window.partitionBy("unique_key").orderBy(end.desc_nulls_last(), *others)
    keyed = rows.where(F.col("unique_key").isNotNull())
    kept = keyed.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return kept.unionByName(rows.where(F.col("unique_key").isNull()).distinct())


def _months_of(df: DataFrame, months) -> DataFrame:
    """The rows of some months; literals that prune the folders that are read."""
    pick = F.lit(False)
    for y, m in sorted(months):
        pick = pick | ((F.col("year") == y) & (F.col("month") == m))
    return df.where(pick)


def _beside(clean_dir: str, name: str) -> str:
    """A folder next to the table (folders below it would be taken for months)."""
    return f"{clean_dir.rstrip('/')}{name}"


def index_keys(spark: SparkSession, clean_dir: str) -> DataFrame:
    """(unique_key, year, month) of the table, from the index; months whose stamp differs are read
    and written again first."""
    path = _beside(clean_dir, KEYS)
    now = stamps.month_stamps(spark, clean_dir)
    known = {}
    if files.exists(spark, path):  # one row per month
        stored = spark.read.schema(_KEY_SCHEMA).parquet(path)
        known = {(r.year, r.month): r.stamp for r in stored.groupBy("year", "month").agg(F.max("stamp").alias("stamp")).collect()}
    for y, m in known.keys() - now.keys():
        files.delete(spark, f"{path}/year={y}/month={m}")
    changed = {m for m in now if known.get(m) != now[m]}
    if changed:
        of = F.create_map(*[x for (y, m), s in now.items() for x in (F.lit(y * 100 + m), F.lit(s))])
        rows = _months_of(storage.read_clean(spark, clean_dir, storage.PARTITIONED_SCHEMA), changed)
        # every file of the table lies in one month, so the index is written as it is read: no month
        # is gathered in a task, and it has about as many files as the table
        (rows.select("unique_key", of[F.col("year") * 100 + F.col("month")].alias("stamp"), "year", "month")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path))
    if not now:  # a table without files has no index
        return spark.createDataFrame([], _KEY_SCHEMA).drop("stamp")
    return spark.read.schema(_KEY_SCHEMA).parquet(path).drop("stamp")


def recover(spark: SparkSession, clean_dir: str) -> bool:
    """Finish a publication that was broken off, or drop what was staged for one. Gives whether
    there was one to finish."""
    journal = _beside(clean_dir, JOURNAL)
    if not files.exists(spark, journal):
        return False
    whole = files.exists(spark, f"{journal}/{COMPLETE}/_SUCCESS")
    if whole:
        _publish(spark, journal, clean_dir)
    files.delete(spark, journal)
    return whole


def _publish(spark: SparkSession, journal: str, clean_dir: str) -> None:
    """Replace the months that the journal names by what it holds. A month of which nothing is left
    is deleted."""
    months = [(r.year, r.month) for r in spark.read.schema("year int, month int").parquet(f"{journal}/{COMPLETE}").collect()]
    rows = spark.read.schema(storage.PARTITIONED_SCHEMA).parquet(f"{journal}/rows")
    filled = {(r.year, r.month) for r in rows.select("year", "month").distinct().collect()}
    storage.write_clean_partitioned(rows, clean_dir)
    for y, m in set(months) - filled:
        files.delete(spark, f"{clean_dir}/year={y}/month={m}")


def merge_batch(fresh: DataFrame, clean_dir: str) -> None:
    """Merge cleaned rows into the partitioned table at ``clean_dir``: the months that they touch and
    those that hold their keys so far."""
    spark = fresh.sparkSession
    recover(spark, clean_dir)
    journal = _beside(clean_dir, JOURNAL)
    keyed = with_partition_keys(fresh).select(*[f.name for f in storage.PARTITIONED_SCHEMA.fields])
    landed = f"{journal}/landed"
    keyed.write.mode("overwrite").parquet(landed)
    keyed = spark.read.schema(storage.PARTITIONED_SCHEMA).parquet(landed)
    touched = {(r.year, r.month) for r in keyed.select("year", "month").distinct().collect()}  # one row per month
    if files.exists(spark, clean_dir):
        moved = index_keys(spark, clean_dir).join(keyed.select("unique_key").distinct(), "unique_key", "left_semi")
        touched |= {(r.year, r.month) for r in moved.select("year", "month").distinct().collect()}
        old = storage.read_clean(spark, clean_dir, storage.PARTITIONED_SCHEMA)
        keyed = keyed.unionByName(_months_of(old, touched).select(*keyed.columns))
    latest_per_key(keyed).write.mode("overwrite").parquet(f"{journal}/rows")
    (spark.createDataFrame(sorted(touched), "year int, month int").coalesce(1).write.parquet(f"{journal}/{COMPLETE}"))
    _publish(spark, journal, clean_dir)
    files.delete(spark, journal)


def start_clean_stream(spark: SparkSession, raw_dir: str, clean_dir: str, checkpoint: str,
                       sla_hours: float = 24.0, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    if not checkpoint:
        raise ValueError("a checkpoint folder of the output's own is needed")
    recover(spark, clean_dir)
    reader = spark.readStream.schema(RAW_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(clean(batch, sla_hours=sla_hours), clean_dir)

    writer = (reader.parquet(raw_dir).writeStream.foreachBatch(merge)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def refresh_once(spark: SparkSession, raw_dir: str, clean_dir: str, checkpoint: str, **kw) -> None:
    """Process everything that has landed, then return."""
    q = start_clean_stream(spark, raw_dir, clean_dir, checkpoint, available_now=True, **kw)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
