"""File-system helpers through Hadoop's FileSystem API (works for any cluster FS)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def any_data_file(spark: SparkSession, root: str, suffix: str = ".parquet") -> bool:
    """True as soon as one data file is found below ``root`` (stops listing early)."""
    fs, p = _fs_and_path(spark, root)
    if not fs.exists(p):
        return False
    it = fs.listFiles(p, True)
    while it.hasNext():
        name = it.next().getPath().getName()
        if not (name.startswith("_") or name.startswith(".")) and name.endswith(suffix):
            return True
    return False


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_and_path(spark, path)
    fs.delete(p, True)


def replace_dir(spark: SparkSession, src: str, dst: str) -> None:
    """Publish a finished output folder: ``dst`` is replaced by ``src``.

    The old folder is renamed aside first and deleted last, so a failed move puts it back
    and at no time is the table neither old nor new for longer than two renames.
    """
    fs, s = _fs_and_path(spark, src)
    _, d = _fs_and_path(spark, dst)
    _, aside = _fs_and_path(spark, f"{dst.rstrip('/')}.replaced")
    parent = d.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    if not fs.exists(s):
        raise FileNotFoundError(src)
    if fs.exists(d):
        fs.delete(aside, True)
        if not fs.rename(d, aside):
            raise OSError(f"could not move {dst} aside")
    moved = False
    try:
        moved = fs.rename(s, d)
    finally:
        if not moved and fs.exists(aside):
            fs.rename(aside, d)
    if not moved:
        raise OSError(f"could not move {src} to {dst}")
    fs.delete(aside, True)
