"""Session construction and scratch locations.

Scratch output goes under the cluster's ``spark.checkpoint.dir``, a folder that the
driver and all executors share. Only a session with a ``local`` master may do
without: it gets a private temporary folder. On any other master a missing
checkpoint folder is an error, because a machine-local one would lose rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ticketscope.sources import files

# Settings the engine relies on. Shuffle partitions are left to the caller on a
# cluster (AQE coalesces small ones); local runs use the core count.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "ticketscope",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a local session without one gets a private folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            current = tempfile.mkdtemp(prefix="ticketscope-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables, known to the
    ``scratch_scope`` that it is made in."""
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders made inside. For jobs that have written what they need when
    they leave; a query that returns a lazy DataFrame keeps its tables."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files.delete(spark, path)
