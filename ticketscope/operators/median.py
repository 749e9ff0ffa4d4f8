"""Exact grouped median whatever the group sizes.

Spark's ``median`` keeps every distinct value of a group in one map merged by one
task, which a group holding a third of a 100 TB table would not fit. Here

1. the first scan computes the other aggregates and, per group, a bracket around
   the middle from ``percentile_approx`` (bounded, mergeable sketches): ranks
   ``0.5 ± 2 / ACCURACY``, wider than the sketch's own error of ``1 / ACCURACY``.
   This table is stored, so the join of the second scan is planned from its true
   size and the lineage is cut. Where the groups are the cells of a fixed domain
   (the whole table, weekdays, hours; ``fixed_groups``), its few rows are held as
   local rows instead;
2. the second scan counts the values below each group's bracket and pre-aggregates
   those inside it as ``(keys, value, count)``, the candidates: about
   ``4 / ACCURACY`` of a group's values;
3. as long as a group has more than ``window_values`` candidates, they are cut into
   ``PARTS`` parts by quantiles of the candidates, the counts of the parts add up to
   ranks, and only the parts that hold the middle stay (rank selection over
   mergeable counts: each pass leaves a thirtieth or so, and reads only the stored
   candidates);
4. the running counts of the candidates, at most ``window_values`` rows in a window,
   give the exact ranks.

The result is Spark's exact ``percentile(x, 0.5)``, interpolation included. There is
no switch by size: every query takes this path. A caller who knows that all
groups are small can ask for ``method="inline"`` (``F.median`` in one scan), for
``method="approx"`` (``percentile_approx``), or for no median at all (``"none"``: null).

``median_of_counts`` takes steps 3 and 4 for a table of values and how often each
occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.session import scratch_dir

METHODS = ("exact", "inline", "approx", "none")
ACCURACY = 10_000
WINDOW_VALUES = 100_000
PARTS = 64
_ALL = "__all"


def aggregate_with_median(df: DataFrame, keys: list[str], aggs: list[Column],
                          median_of: Column | str | None, median_alias: str,
                          method: str = "exact", order: list[str] | None = None,
                          accuracy: int = ACCURACY, fixed_groups: bool = False,
                          window_values: int = WINDOW_VALUES) -> DataFrame:
    """``groupBy(keys).agg(*aggs, median(median_of) AS median_alias)``, skew-safe.

    Null group keys are kept as groups. Output columns: keys, aggregates and the
    median, or those of ``order``. ``fixed_groups``: the keys come from a domain that doesn't
    grow with the data, so a row per group may pass through the driver.
    """
    value = F.col(median_of) if isinstance(median_of, str) else median_of
    if method == "inline":
        out = df.groupBy(*keys).agg(*aggs, F.median(value).alias(median_alias))
    elif method == "approx":
        out = df.groupBy(*keys).agg(*aggs, F.percentile_approx(value, 0.5, accuracy).alias(median_alias))
    elif method == "none":
        out = df.groupBy(*keys).agg(*aggs).withColumn(median_alias, F.lit(None).cast("double"))
    elif method == "exact":
        out = _exact(df, keys, aggs, value.cast("double"), median_alias, accuracy, fixed_groups or not keys, window_values)
    else:
        raise ValueError(f"unknown median method {method!r}, not one of {METHODS}")
    return out.select(*order) if order else out


def median_of_counts(df: DataFrame, keys: list[str], value: str, count: str, alias: str,
                     window_values: int = WINDOW_VALUES) -> DataFrame:
    """Per group the exact median of ``value``, each taken ``count`` times; nulls don't count."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v"))
              .agg(F.sum(count).alias("__c")))
    totals = _stored(counts, "median-candidates")
    if _largest(totals, keys) <= window_values:  # the groups pass a window whole, which gives their sums as well
        return _middle(totals.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys))), keys, alias)
    of = totals.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    return _middle(_narrowed(_joined(totals, of, keys, ["__n"]), keys, window_values), keys, alias)


def _largest(counts: DataFrame, by: list[str]) -> int:
    """The most values of a group."""
    return counts.groupBy(*by).agg(F.count("__v").alias("__m")).agg(F.max("__m")).first()[0] or 0


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], columns: list[str], how: str = "inner") -> DataFrame:
    """Rows with columns of their group; null keys are equal."""
    right = groups.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *columns)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(right, same, how).drop(*[f"__k_{k}" for k in keys])


def _ranks() -> tuple[Column, Column]:
    """The two middle ranks of ``__n`` values, counted from 0."""
    return F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)


def _narrowed(counts: DataFrame, by: list[str], window_values: int) -> DataFrame:
    """The candidates (by, __v, __c, __n) with at most ``window_values`` values a group. A null __v
    stands for all values below the others."""
    counts = _stored(counts, "median-candidates")
    left = None
    while True:
        most = _largest(counts, by)
        if most <= window_values or left is not None and most >= left:
            return counts
        left = most
        shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
        cuts = counts.groupBy(*by).agg(F.percentile_approx("__v", shares, F.lit(ACCURACY)).alias("__cuts"))
        # part 0 is what lies below; a value belongs to the part after the cuts that it exceeds
        part = F.when(F.col("__v").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))) + 1)
        parted = _joined(counts, cuts, by, ["__cuts"]).withColumn("__part", part).drop("__cuts")
        upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__part"))  # PARTS + 1 rows a group
        low, high = _ranks()
        parts = (parted.groupBy(*by, "__part").agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
                 .withColumn("__upto", upto)
                 .select(*by, F.col("__part").alias("__of"), (F.col("__upto") <= low).alias("__below"),
                         (F.col("__upto") - F.col("__c") > high).alias("__above")))
        same = F.col("__part") == F.col("__of")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"__p_{k}"))
        judged = parted.join(parts.select(*[F.col(k).alias(f"__p_{k}") for k in by], "__of", "__below", "__above"), same)
        value = F.when(~F.col("__below"), F.col("__v"))
        counts = _stored(judged.where(~F.col("__above")).groupBy(*by, value.alias("__v"))
                         .agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n")), "median-candidates")


def _middle(counts: DataFrame, by: list[str], alias: str) -> DataFrame:
    """Per group the value in the middle, or the mean of the two."""
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first())
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def at(rank):  # the value that holds a rank counted from 0
        return F.min(F.when((F.col("__v").isNotNull()) & (F.col("__upto") > rank), F.col("__v")))
    low, high = _ranks()
    middle = counts.withColumn("__upto", upto).groupBy(*by).agg(at(low).alias("__a"), at(high).alias("__b"))
    return middle.select(*by, F.when(F.col("__a") == F.col("__b"), F.col("__a"))
                         .otherwise(F.lit(0.5) * F.col("__a") + F.lit(0.5) * F.col("__b")).alias(alias))


def _exact(df: DataFrame, keys: list[str], aggs: list[Column], value: Column, alias: str,
           accuracy: int, fixed_groups: bool, window_values: int) -> DataFrame:
    reach = 2.0 / accuracy
    bracket = F.percentile_approx(value, F.array(F.lit(max(0.5 - reach, 0.0)), F.lit(min(0.5 + reach, 1.0))), F.lit(accuracy))
    base = df.groupBy(*keys).agg(*aggs, F.count(value).alias("__n"), bracket.alias("__at"))
    base = _local(base) if fixed_groups else _stored(base, "median-brackets")
    names = [c for c in base.columns if c not in ("__n", "__at")]

    if keys:
        ends = base.withColumns({"__lo": F.get("__at", F.lit(0)), "__hi": F.get("__at", F.lit(1))})
        rows = _joined(df.select(*keys, value.alias("__v")).where(F.col("__v").isNotNull()), ends, keys, ["__n", "__lo", "__hi"])
    else:
        # one row: its bracket becomes literals, which also reach the scan as filters
        row = base.select("__n", "__at").first()
        lo, hi = row["__at"] or (None, None)
        rows = df.select(F.lit(0).alias(_ALL), value.alias("__v")).where(F.col("__v") <= F.lit(hi).cast("double")).select(
            _ALL, "__v", F.lit(row["__n"]).alias("__n"), F.lit(lo).cast("double").alias("__lo"),
            F.lit(hi).cast("double").alias("__hi"))
    by = keys or [_ALL]
    # values below the bracket share one row per group, marked by a null value
    inside = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counts = (rows.where(F.col("__v") <= F.col("__hi")).groupBy(*by, inside.alias("__v"))
              .agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n")))
    med = _middle(_narrowed(counts, by, window_values), by, alias)
    if not keys:
        row = med.select(alias).first()
        return base.select(*names, F.lit(row[0] if row else None).cast("double").alias(alias))
    return _joined(base.select(*names), med, keys, [alias], "left").select(*names, alias)
