"""Hard negatives by Strassen products of anchor and candidate tiles.

Rows of embeddings become int64 vectors floor(256 * x). Anchors (a stated part of the rows) and
candidates (all rows) are dealt by hash to the cells of a grid, so that every anchor meets every
candidate in one cell. A task reads a cell's anchors, then its candidates as they come, in tiles
of at most `TILE_ROWS` rows: it holds the cell's anchors, one tile and the scores of `ANCHOR_ROWS`
anchors. Scores are products of the two matrices by Strassen's recursion, padded with zero rows and
columns to even sizes; sums wrap modulo 2**64, so a score is exact if it fits in 64 bits, whatever
the intermediate sums.

Two passes, each leaving mergeable heaps of bounded size:
1. of every anchor the best `n_positives` rows of its label; heaps are merged tile after tile in
   the task, then over cells by a window;
2. of every anchor and positive the best `n_negatives` rows of other labels within the window
   least * positive <= score <= most * positive (hundredths), merged likewise.

Order is by descending score, then ascending id (null last), then the place of the row.

Rows with a null label, a null vector or a null or non-finite component take no part; an empty
vector has score 0 with all, a shorter one counts as padded with zeros. A null id is no anchor and
may be a positive or negative. Repeated rows are rows of their own, each an anchor if its id says
so, and other rows to one another. Vectors so long that a score could pass 63 bits are an error.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import batch_of, store

SCALE = 256
ANCHOR_EVERY = 50
N_POSITIVES = 5
N_NEGATIVES = 3
LEAST, MOST = 50, 95
ANCHOR_ROWS = 512
TILE_ROWS = 4096
CELL_ANCHORS = 1 << 13
CELL_ROWS = 1 << 18
SIDE = 6  # cells a side at least, where there are rows enough
LEAF = 32

NONE = np.iinfo(np.int64).min  # no score: Cauchy-Schwarz keeps scores above
NO_ID = np.iinfo(np.int64).max  # a null id sorts last


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64 arithmetic (modulo 2**64), by seven products of half the size while every
    side is over `leaf`."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= leaf:
        return a @ b
    rows, cols = a.shape[0], b.shape[1]
    if rows % 2 or a.shape[1] % 2:
        a = np.pad(a, ((0, rows % 2), (0, a.shape[1] % 2)))
    if cols % 2 or b.shape[0] % 2:
        b = np.pad(b.T, ((0, cols % 2), (0, b.shape[0] % 2))).T
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:d, :n], b[:d, n:], b[d:, :n], b[d:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :cols]


class Rows:
    """Some rows in ascending order of id and place: places, ids, labels and vectors."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = {n: batch_of(batch, n) for n in ("place", "vec_id", "label", "vector")}
        ids = column["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
        places = column["place"].to_numpy(zero_copy_only=False)
        self.order = np.lexsort((places, ids))
        self.ids, self.places = ids[self.order], places[self.order]
        self.labels = column["label"].to_numpy(zero_copy_only=False)[self.order]
        lists = column["vector"]
        lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
        vectors[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
        self.vectors = vectors[self.order]

    def scores(self, tile: Rows) -> np.ndarray:
        d = min(self.vectors.shape[1], tile.vectors.shape[1])  # what is longer meets zeros
        return strassen(self.vectors[:, :d], tile.vectors[:, :d].T)


class Heaps:
    """The best `size` (score, id, place) of each of `n` keys. Heaps of the same keys merge."""

    def __init__(self, n: int, size: int) -> None:
        self.scores, self.ids, self.places = np.full((n, size), NONE), np.full((n, size), NO_ID), np.full((n, size), NO_ID)

    def merge(self, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        size = self.scores.shape[1]
        every = [np.concatenate(x, axis=1) for x in ((self.scores, scores), (self.ids, ids), (self.places, places))]
        turn = np.lexsort((every[2], every[1], ~every[0]), axis=1)[:, :size]
        self.scores, self.ids, self.places = (np.take_along_axis(x, turn, 1) for x in every)

    def take(self, scores: np.ndarray, tile: Rows) -> None:
        """Merge the best of a tile. `scores` holds NONE where a row is no candidate, and is used
        up. Columns are in order of id, so the first of the greatest comes first in order."""
        size, keys = self.scores.shape[1], np.arange(len(scores))
        found, at = np.empty((len(scores), size), np.int64), np.empty((len(scores), size), np.int64)
        for i in range(size):
            at[:, i] = scores.argmax(axis=1)
            found[:, i] = scores[keys, at[:, i]]
            scores[keys, at[:, i]] = NONE
        none = found == NONE
        self.merge(found, np.where(none, NO_ID, tile.ids[at]), np.where(none, NO_ID, tile.places[at]))


class Positives:
    """Of every anchor the best rows of its label, itself left out."""

    def __init__(self, anchors: Rows, batch: pa.RecordBatch, size: int) -> None:
        self.anchors, self.heaps = anchors, Heaps(len(anchors.ids), size)

    def see(self, tile: Rows, scores: np.ndarray) -> None:
        own = self.anchors
        fits = (own.labels[:, None] == tile.labels) & (own.places[:, None] != tile.places)
        if fits.any():
            self.heaps.take(np.where(fits, scores, NONE), tile)

    def found(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(self.heaps.scores != NONE)
        yield _batch(self.anchors.places[i], np.zeros(len(i), np.int64), self.heaps, i, j)


class Negatives:
    """Of every anchor and positive the best rows of other labels within the positive's window."""

    def __init__(self, anchors: Rows, batch: pa.RecordBatch, size: int, least: int, most: int) -> None:
        goals = batch_of(batch, "goals").to_pylist()
        width = max(len(g or []) for g in goals)
        self.anchors = anchors
        self.low, self.high = np.ones((len(goals), width), np.int64), np.zeros((len(goals), width), np.int64)
        for row, at in enumerate(anchors.order.tolist()):
            for j, p in enumerate(goals[at] or []):  # least * p <= 100 * score <= most * p
                self.low[row, j], self.high[row, j] = -(-least * p // 100), most * p // 100
        self.heaps = [Heaps(len(goals), size) for _ in range(width)]

    def see(self, tile: Rows, scores: np.ndarray) -> None:
        other = self.anchors.labels[:, None] != tile.labels
        for j, heaps in enumerate(self.heaps):
            fits = other & (scores >= self.low[:, j, None]) & (scores <= self.high[:, j, None])
            some = np.flatnonzero(fits.any(axis=1))
            if len(some):
                part = Heaps(len(some), heaps.scores.shape[1])
                part.scores, part.ids, part.places = heaps.scores[some], heaps.ids[some], heaps.places[some]
                part.take(np.where(fits[some], scores[some], NONE), tile)
                heaps.scores[some], heaps.ids[some], heaps.places[some] = part.scores, part.ids, part.places

    def found(self) -> Iterator[pa.RecordBatch]:
        for goal, heaps in enumerate(self.heaps):
            i, j = np.nonzero(heaps.scores != NONE)
            yield _batch(self.anchors.places[i], np.full(len(i), goal), heaps, i, j)


_FOUND = "anchor long, goal long, score long, vec_id long, place long"


def _batch(anchors: np.ndarray, goals: np.ndarray, heaps: Heaps, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    ids = heaps.ids[i, j]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors), pa.array(goals), pa.array(heaps.scores[i, j]), pa.array(ids, mask=ids == NO_ID), pa.array(heaps.places[i, j])],
        names=["anchor", "goal", "score", "vec_id", "place"])


def _search(batches: Iterator[pa.RecordBatch], kind) -> Iterator[pa.RecordBatch]:
    """The rows of some cells, each cell's anchors before its candidates."""
    cell, anchors, heaps = None, [], []
    for batch in batches:
        keys = batch_of(batch, "cell").to_numpy(zero_copy_only=False)
        roles = batch_of(batch, "role").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if keys[start] != cell:
                for h in heaps:
                    yield from h.found()
                cell, anchors, heaps = keys[start], [], []
            if roles[start] == 0:
                anchors.append(batch.slice(start, end - start))
                continue
            if anchors:
                table = pa.Table.from_batches(anchors).combine_chunks()
                heaps = [kind(Rows(b), b) for b in table.to_batches(max_chunksize=ANCHOR_ROWS)]
                anchors = []
            for at in range(start, end, TILE_ROWS):
                tile = Rows(batch.slice(at, min(TILE_ROWS, end - at)))
                for h in heaps:
                    h.see(tile, h.anchors.scores(tile))
    for h in heaps:
        yield from h.found()


def prepare(embeddings: DataFrame) -> DataFrame:
    """(place, vec_id, label, vector) of the rows that take part; a stored table, so that a row's
    place stays. Labels of ids divisible by 7 move on by one."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = (embeddings.where(sound & F.col("label").isNotNull())
            .select(F.monotonically_increasing_id().alias("place"), F.col("vec_id").cast("long"), moved.alias("label"),
                    F.transform(vector, lambda x: F.floor(x * SCALE)).alias("vector")))
    return store(rows, "vectors")


def _check_lengths(rows: DataFrame) -> None:
    """Scores stay within the square of the greatest length."""
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    if (rows.agg(F.max(length)).first()[0] or 0) >= 2.0**62:
        raise ValueError("the vectors are so long that scores could pass 63 bits")


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Every anchor and every row once in each cell of its line or column of the grid."""
    def side(n: int, most: int) -> int:
        return max(-(-n // most), min(SIDE, -(-n // 256)), 1)
    lines, columns = side(n_anchors, CELL_ANCHORS), side(n_rows, CELL_ROWS)

    def dealt(df: DataFrame, own: int, other: int, role: int, cell) -> DataFrame:
        at = F.pmod(F.xxhash64("place"), F.lit(own))
        return (df.withColumn("own", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
                .select(cell(F.col("own"), F.col("other")).cast("long").alias("cell"), F.lit(role).alias("role"),
                        "place", "vec_id", "label", "vector", "goals"))
    every = rows.withColumn("goals", F.lit(None).cast("array<long>"))
    both = (dealt(anchors, lines, columns, 0, lambda own, other: own * columns + other)
            .union(dealt(every, columns, lines, 1, lambda own, other: other * columns + own)))
    return both.repartition(min(lines * columns, 1 << 14), "cell").sortWithinPartitions("cell", "role")


def _best(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(embeddings: DataFrame, anchor: Column | None = None, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
         least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. `anchor` says which rows are anchors (those of ids divisible by 50)."""
    rows = prepare(embeddings)
    _check_lengths(rows)
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0 if anchor is None else anchor
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()

    first = _cells(rows, anchors.withColumn("goals", F.lit(None).cast("array<long>")), n_rows, n_anchors)
    search = partial(_search, kind=partial(Positives, size=n_positives))
    positives = store(_best(first.mapInArrow(search, _FOUND), ["anchor"], n_positives)
                      .select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    goals = positives.groupBy(F.col("anchor").alias("place")).agg(  # n_positives entries at most
        F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).getField("positive_score").alias("goals"))
    second = _cells(rows, anchors.join(goals, "place"), n_rows, n_anchors)
    search = partial(_search, kind=partial(Negatives, size=n_negatives, least=least, most=most))
    negatives = _best(second.mapInArrow(search, _FOUND), ["anchor", "goal"], n_negatives).select(
        "anchor", (F.col("goal") + 1).alias("goal"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = positives.withColumnRenamed("rank", "goal")
    names = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(chosen, ["anchor", "goal"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
