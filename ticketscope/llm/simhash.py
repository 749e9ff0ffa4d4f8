"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, components.

Fingerprints within `radius` differing bits are linked. Distinct fingerprints are laid out in
tiles by the population counts of their eight bytes: two fingerprints at distance d have byte
counts that differ by at most d in total, so a pair of tiles whose counts differ by more than the
radius is skipped and every other pair is compared exactly (numpy exclusive-or and bit counts).
Each unordered tile pair is met once: a fingerprint stays at home in its own tile and visits the
half of the neighbouring tiles that sorts above it. Tiles above `tile_rows` are cut into parts.

A task emits a spanning forest of the links in its tile pairs, not all pairs, so a dense group
costs rows in proportion to its members. Components come from alternating large-star and
small-star steps over tables in the shared scratch folder.

Nulls, empty and blank texts have fingerprint zero and are linked like any other. Rows that
repeat a doc_id or a text are kept, one result row each. A null doc_id never names a component
unless the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.llm.common import as_bytes, batch_of, hands_back, null_safe_keys, store
from ticketscope.session import scratch_dir, scratch_scope
from ticketscope.sources import files

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
TILE_ROWS = 4096
_BLOCK = 255 * 128


def fingerprint(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    tails = [words[i:] for i in range(words_per_shingle)]
    shingles = map(b" ".join, zip(*tails)) if len(words) >= words_per_shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[start:start + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit in a byte
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


@hands_back
def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int, name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = _signed([fingerprint(t, words) for t in as_bytes(batch_of(b, "text"))])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], names=[*b.schema.names, name])


def with_fingerprint(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS,
                     name: str = "fingerprint") -> DataFrame:
    """All columns and the signed fingerprint under a name the input doesn't use."""
    schema = T.StructType([*docs.schema, T.StructField(name, T.LongType())])
    return docs.mapInArrow(partial(_fingerprint_batches, words=words_per_shingle, name=name), schema)


def _offsets(radius: int) -> np.ndarray:
    """Byte-count differences of at most `radius` in total; of each pair of opposites the one
    whose first difference is positive."""
    found = [()]
    for _ in range(8):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1)
                 if sum(map(abs, f)) + abs(d) <= radius]
    return np.array([f for f in found if f > (0,) * 8], dtype=np.int64)


_PLACES = 16 ** np.arange(7, -1, -1, dtype=np.int64)


def _counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint8).reshape(-1, 8)).astype(np.int64)


@hands_back
def _tile_batches(batches: Iterator[pa.RecordBatch], radius: int, visits: bool) -> Iterator[pa.RecordBatch]:
    """(tile, visitor, fp): each fingerprint at home, with `visits` also in the upper neighbours."""
    offsets = _offsets(radius) if visits else []
    for b in batches:
        prints = np.ascontiguousarray(batch_of(b, "fp").to_numpy(zero_copy_only=False))
        counts = _counts(prints)
        home = counts @ _PLACES

        def rows(tile, fps, visitor):
            return pa.RecordBatch.from_arrays(
                [pa.array(tile), pa.array(np.full(len(fps), visitor)), pa.array(fps)],
                names=["tile", "visitor", "fp"])
        yield rows(home, prints, False)
        for d in offsets:
            there = counts + d
            fits = ((there >= 0) & (there <= 8)).all(axis=1)
            yield rows(there[fits] @ _PLACES, prints[fits], True)


class _Forest:
    """Union-find over the home fingerprints of one tile part."""

    def __init__(self) -> None:
        self.prints = np.empty(0, np.int64)
        self.label = np.empty(0, np.int64)

    def _find(self) -> None:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return
            self.label = up

    def link(self, prints: np.ndarray, radius: int, grow: bool) -> tuple[np.ndarray, np.ndarray]:
        """Compare new fingerprints with the home ones. Homes grow by them if `grow`;
        else edges of visitors to a home of each group that they touch are returned."""
        if grow:
            start = len(self.prints)
            self.prints = np.concatenate([self.prints, prints])
            self.label = np.concatenate([self.label, np.arange(start, len(self.prints))])
        out_a, out_b = [], []
        step = max(1, (1 << 20) // max(1, len(self.prints)))
        for i in range(0, len(prints), step):
            block = prints[i:i + step]
            near = np.bitwise_count((block[:, None] ^ self.prints[None, :]).view(np.uint64)) <= radius
            row, col = np.nonzero(near)
            if not len(row):
                continue
            if grow:
                row = row + start + i
                self._join(row, col)
            else:
                # homes met by one visitor are one group: chain them to its first
                first = np.full(len(block), len(self.prints), np.int64)
                np.minimum.at(first, row, col)
                self._join(first[row], col)
                met = np.unique(row)
                out_a.append(block[met])
                out_b.append(self.prints[first[met]])
        none = np.empty(0, np.int64)
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            self._find()
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                return
            low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
            np.minimum.at(self.label, high, low)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self._find()
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.prints[child], self.prints[self.label[child]]


@hands_back
def _compare_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (tile, part, visitor): a part's homes, then its visitors."""
    key, forest = None, _Forest()

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        tile, part, fps = (np.ascontiguousarray(batch_of(batch, c).to_numpy(zero_copy_only=False))
                           for c in ("tile", "part", "fp"))
        visitor = np.asarray(batch_of(batch, "visitor").to_numpy(zero_copy_only=False), dtype=bool)
        if not len(tile):
            continue
        cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(visitor) != 0)) + 1
        found = []
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(tile)]):
            now = (tile[lo], part[lo])
            if now != key:
                if len(forest.prints) > 1:
                    found.append(forest.edges())
                key, forest = now, _Forest()
            if visitor[lo]:
                if len(forest.prints):
                    found.append(forest.link(fps[lo:hi], radius, grow=False))
            else:
                forest.link(fps[lo:hi], radius, grow=True)
        if found:
            yield out(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    if len(forest.prints) > 1:
        yield out(*forest.edges())


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that span every group of distinct fingerprints `fp` linked within `radius`.

    `prints` must be a stored table of distinct values. Parts of a large tile also meet each
    other: a home row visits the parts above its own.
    """
    schema = "tile long, visitor boolean, fp long"
    home = prints.select("fp").mapInArrow(partial(_tile_batches, radius=radius, visits=False), schema)
    large = store(home.groupBy("tile").agg(F.count("*").alias("rows")).filter(F.col("rows") > tile_rows)
                  .select("tile", F.ceil(F.col("rows") / tile_rows).cast("int").alias("parts")),
                  "simhash-large-tiles")
    rows = prints.select("fp").mapInArrow(partial(_tile_batches, radius=radius, visits=True), schema)
    # `large` is a stored table, so its true size decides between broadcast and sort-merge join
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    many = F.col("parts").isNotNull()
    dealt = rows.join(large, "tile", "left").withColumn(
        "to", F.when(~many, F.array(F.lit(0)))
        .when(F.col("visitor"), F.sequence(F.lit(0), F.col("parts") - 1))
        .otherwise(F.sequence(own, F.col("parts") - 1)))
    placed = dealt.select("tile", F.explode("to").alias("part"), "fp", "visitor", F.col("to")[0].alias("first"))
    placed = placed.select("tile", "part", "fp",
                           (F.col("visitor") | (F.col("part") != F.col("first"))).alias("visitor"))
    return (placed.repartition("tile", "part").sortWithinPartitions("tile", "part", "visitor", "fp")
            .mapInArrow(partial(_compare_batches, radius=radius), "a long, b long"))


def _star_step(e: DataFrame, path: str) -> None:
    """One large-star and one small-star step over edges (v, u), v > u; written to `path`."""
    with scratch_scope(e.sparkSession):
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(
            F.col("v").alias("c"), F.least("v", "m").alias("m"))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        big = store(both.join(low, both.v == low.c).filter(F.col("u") > F.col("v"))
                    .select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct(), "large-star")
        # small star: neighbours below a node, and the node, move to the smallest of them
        least = big.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "c")
        (big.join(least, big.v == least.c).select(F.col("u").alias("v"), F.col("m").alias("u"))
         .union(least.select(F.col("c").alias("v"), F.col("m").alias("u")))
         .filter("u < v").distinct().write.parquet(path))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges.

    Alternating large-star and small-star steps; none grows the edges, each is stored and replaces
    the one before, and the loop ends when the edge set no longer changes. Hot nodes are only
    met by partial aggregates and by joins whose large partitions Spark splits.
    """
    spark, mark = edges.sparkSession, None
    path = scratch_dir(spark, "components")
    (edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
     .filter("u < v").distinct().write.parquet(path))
    while True:
        e = spark.read.schema("v long, u long").parquet(path)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark, old, path = now, path, scratch_dir(spark, "components")
        _star_step(e, path)
        files.delete(spark, old)


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id) per row. root is the smallest fingerprint (as a signed
    number) of the component, component_id the smallest doc_id in it."""
    rows = store(with_fingerprint(docs.select("doc_id", "text"), words_per_shingle, "fp")
                 .select("doc_id", "fp"), "simhash-prints")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-classes")
    roots = components(links(classes, radius, tile_rows))
    in_group = store(classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    smallest = in_group.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = in_group.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates, all columns. Of each component the row with its
    smallest doc_id stays (a null doc_id only if it has no other). Of rows that repeat that
    doc_id within the component one stays: that with the smallest fingerprint, then text."""
    found = near_duplicates(docs, words_per_shingle, radius)
    chosen = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .groupBy("root").agg(F.min("fp").alias("__fp"), F.first("doc_id").alias("doc_id")))
    left, keys = null_safe_keys(with_fingerprint(docs, words_per_shingle, "__fp"), "doc_id", "__k")
    right, _ = null_safe_keys(chosen.select("doc_id", "__fp"), "doc_id", "__k")
    joined = left.join(right.drop("doc_id"), [*keys, "__fp"])
    first = Window.partitionBy(*keys, "__fp").orderBy("text")
    return joined.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*docs.columns)
