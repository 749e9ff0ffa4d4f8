"""Mixing sources to target weights along a curriculum. DataFrame functions only.

Targets: the budget is shared out by weight; no source takes over `max_epochs` times its size,
and the excess is reshared by weight among the others until none is above (water-filling: with
sources ordered by size / weight, the level of the water is solved from running sums).

Order: a source's documents are read in the order of a hash of doc_id, again from the start for
each epoch. Token c of a source is due when the source's cumulative demand reaches c: its weight
over training time t in [0, 1] is piecewise linear between knots, the integral is scaled to the
target and inverted (a quadratic per piece), and gives the training position of every document
copy. The copy that passes the target is taken in part: taken counts the words up to the target.
So each source's taken words are its target, rounded down to a word.

Running sums never gather a source in one task: sums per first digits of the hash, per second
digits, per (hash, size) and per partition of the stored sizes are added up first, so rows only meet
in one cell if they share doc_id, size and the partition that they were read in. A null doc_id, or
one that a third of the rows repeat, is spread like this.

Null texts have size 0 (taken 0). A null source is a source of its own, last in order. A null
doc_id is hashed as such. Rows that repeat a doc_id are documents of their own, ordered by size;
of equal ones the results are the same in any order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import WORD, store

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
DIGITS = 2  # hex digits of the hash at each of two levels
SEED = 20

#: Weight over training time as (time, factor) knots, one schedule per weight in turn: the
#: heaviest sources rise to the end, the middle ones stay, the lightest fade out.
SCHEDULES = (((0.0, 0.5), (0.8, 1.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.6, 1.0), (1.0, 0.25)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
                   schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row per source.

    A source is full if its room per weight is at most the level that the rest of the budget
    reaches: level(i) = (budget - rooms of the sources before i) / weights from i on, with sources
    in the order of room per weight.
    """
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_source) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), turn.cast("int") + 1)
    rows = (sizes.withColumn("turn", turn).withColumn("weight", w)
            .withColumn("room", F.col("source_size") * F.lit(float(max_epochs))))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(budget)
                                     - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
    full = F.col("room") <= F.col("level") * F.col("weight")
    # the first source that isn't full fixes the level for all after it
    fixed = F.min(F.when(~full, F.struct(F.col("room") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    target = F.least("room", F.coalesce(fixed["level"], F.col("room") / F.col("weight")) * F.col("weight"))
    return rows.select("source", "source_size", "turn", target.alias("target"))


def _pieces(schedule) -> Column:
    """Start time, start and end factor and the share of the whole integral before each piece."""
    whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:]))
    done, out = 0.0, []
    for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
        out.append(F.struct(F.lit(t0).alias("t0"), F.lit(t1 - t0).alias("dt"), F.lit(a / whole).alias("a"),
                            F.lit(b / whole).alias("b"), F.lit(done).alias("done")))
        done += (t1 - t0) * (a + b) / 2 / whole
    return F.array(*out)


def _due(share: Column, turn: Column, schedules) -> Column:
    """The time at which the integral of the schedule reaches a share in [0, 1]."""
    pieces = F.element_at(F.array(*map(_pieces, schedules)), (turn % len(schedules)).cast("int") + 1)
    p = F.element_at(F.filter(pieces, lambda x: x["done"] <= share), -1)
    # a t + (b - a) / dt * t^2 / 2 = share - done, solved without loss of digits when b is near a
    need = share - p["done"]
    slope = (p["b"] - p["a"]) / p["dt"]
    root = F.sqrt(F.greatest(p["a"] * p["a"] + 2 * slope * need, F.lit(0.0)))
    return F.least(p["t0"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (p["a"] + root)), F.lit(1.0))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
        schedules=SCHEDULES, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and positions: the training
    time in [0, 1] of each copy taken."""
    return _mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")),
                weights, budget, max_epochs, schedules, seed)


def _starts(rows: DataFrame, on: list[str], levels: list[str], target: DataFrame) -> DataFrame:
    """(on, levels, base, columns of target): the sizes of a source's rows before each cell. Each
    level's cells are summed up and put in order within the cell above, so no window holds a whole
    source. The source's own row of `target` joins the few cells of the first level."""
    extra = [c for c in target.columns if c not in on]
    before = (Window.unboundedPreceding, -1)
    cells = [rows.groupBy(*on, *levels).agg(F.sum("size").alias("size"))]
    for depth in range(len(levels) - 1, 0, -1):
        cells.insert(0, cells[0].groupBy(*on, *levels[:depth]).agg(F.sum("size").alias("size")))
    base = None
    for depth, sums in enumerate(cells):
        above, here = [*on, *levels[:depth]], [*on, *levels[:depth + 1]]
        inside = F.coalesce(F.sum("size").over(Window.partitionBy(*above).orderBy(levels[depth]).rowsBetween(*before)), F.lit(0))
        own = sums.select(*here, inside.alias("inside"))
        base = own.withColumnRenamed("inside", "base").join(target, on) if base is None else (
            own.join(base, above).select(*here, (F.col("base") + F.col("inside")).alias("base"), *extra))
    return base


def _mix(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES,
         seed: int = SEED) -> DataFrame:
    """`mix` of (doc_id, source, size); further columns are carried along."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    levels = ["d1", "d2", "d3", "d4"]
    rows = store(sized.withColumn("d3", key)
                 .withColumn("d1", F.substring("d3", 1, DIGITS)).withColumn("d2", F.substring("d3", 1 + DIGITS, DIGITS))
                 .withColumn("d3", F.concat(F.substring("d3", 1 + 2 * DIGITS, 32), F.lpad(F.hex("size"), 16, "0")))
                 .withColumn("d4", F.spark_partition_id()), "mix-sizes")
    rows, on = null_safe_keys_text(rows)
    totals = rows.groupBy(*on).agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    target = source_targets(totals.select("source", "source_size"), weights, budget, max_epochs)
    target = null_safe_keys_text(target)[0].drop("source")
    inside = Window.partitionBy(*on, *levels).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(_starts(rows, on, levels, target), [*on, *levels])
              .withColumn("start", F.col("base") + F.col("inside")))

    goal = F.floor("target")

    def part(epoch):  # words of the copy in this epoch that lie before the target
        return F.greatest(F.least(F.col("size"), goal - F.col("source_size") * epoch - F.col("start")), F.lit(0))
    copies = [part(e) for e in range(max_epochs)]
    share = [(F.col("start") + F.col("source_size") * e) / F.col("target") for e in range(max_epochs)]
    positions = F.array_compact(F.array(*(F.when(c > 0, _due(s, F.col("turn"), schedules)) for c, s in zip(copies, share))))
    return placed.select(*sized.columns, "source_size", "target",
                         sum(copies[1:], copies[0]).cast("long").alias("taken"), positions.alias("positions"))


def null_safe_keys_text(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    return (rows.withColumn("s_value", F.coalesce("source", F.lit(""))).withColumn("s_null", F.col("source").isNull()),
            ["s_value", "s_null"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`mix`, range-sorted by the first training position (documents not taken last)."""
    return mix(docs, **options).withColumn("position", F.get("positions", F.lit(0))).orderBy(
        F.col("position").asc_nulls_last(), "doc_id", "size")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The training set: a row per copy taken, with the columns of `docs`, range-sorted by training
    position. Texts stay whole, so the last copy of a source may pass its target by a part of
    one document. Rows are told apart by a digest of all their columns; of rows that are alike in
    every column one is read and given the positions of all."""
    row = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("__row"))
    plan = store(_mix(sized, **options).filter("taken > 0").select("__row", "positions"), "mix-plan")
    often = store(plan.groupBy("__row").count().filter("count > 1").select("__row"), "mix-alike")
    rows = docs.withColumn("__row", row)
    once = rows.join(plan.join(often, "__row", "left_anti"), "__row")
    alike = rows.join(often, "__row", "left_semi").dropDuplicates(["__row"]).join(plan.join(often, "__row", "left_semi"), "__row")
    copies = once.unionByName(alike).select(*docs.columns, F.explode("positions").alias("__position"))
    return copies.orderBy("__position", "doc_id").select(*docs.columns)
