"""Ranked lexical search over norm buckets.

Every document is a vector of integer impacts over the terms that queries hold, every item a vector
of integer weights; the score is their inner product. As in LEMP, document vectors are ordered by
length and cut into buckets. For each bucket and item, with the score of the tenth best document so
far as threshold:
1. Cauchy-Schwarz: a bucket whose longest vector times the item's length is below the threshold is
   left out;
2. coordinate bounds: so is one whose greatest impacts of the item's terms don't add up to it;
3. inside, the heaviest terms are added up first; by Cauchy-Schwarz on the other coordinates, a
   document whose sum and rest can't reach the threshold is left out;
4. what is left is scored again, exactly, in 64-bit integers.
A bound leaves a document out only if it is below the threshold (by more than the rounding of
doubles), so ties stay.

Documents are range-sorted by descending length over tasks. The longest `SEED_DOCS` vectors are
searched first; their tenth scores are the threshold that all tasks begin with. Tasks give each
item's ten best, a window merges them.

Items are taken in blocks of at most `block_terms` terms, a job each, so what a task is sent is
bounded by the block; a single longer item is a block of its own. Counts of the corpus cover all
documents. Terms of a text are longest runs of ASCII letters, lower-cased, digits and characters
beyond ASCII.

A null text or item has no terms: such a document isn't counted or found, such an item finds
nothing. Rows that repeat an item_id are items of their own; rows that repeat a doc_id are documents
of their own. Null doc_ids come last among equal scores. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import as_bytes, batch_of, slices, store
from ticketscope.llm.decontaminate import words_of

BEST = 10
BLOCK_TERMS = 1 << 16
BUCKET_DOCS = 2048
SEED_DOCS = 4096
SLICE_BYTES = 8 << 20
SAFE = 1 + 1e-9  # more than the rounding of a bound in doubles
NULL_ID = np.iinfo(np.int64).max


class Items:
    """Some items: `terms` numbers their distinct terms; item i has the terms term[start[i]:start[i + 1]]
    with `times` repeats each."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]) -> None:
        self.rows = [row for row, _ in rows]
        self.terms: dict[bytes, int] = {}
        counts = [Counter(words) for _, words in rows]
        for c in counts:
            for word in c:
                self.terms.setdefault(word, len(self.terms))
        self.start = np.cumsum([0, *map(len, counts)])
        self.term = np.array([self.terms[w] for c in counts for w in c], np.int64)
        self.times = np.array([n for c in counts for n in c.values()], np.int64)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Query:
    """Items with the weights of their terms, heaviest first, and the lengths that bounds need."""

    def __init__(self, items: Items, weight: np.ndarray) -> None:
        value = items.times * weight[items.term]
        owner = np.repeat(np.arange(len(items.rows)), np.diff(items.start))
        turn = np.lexsort((-value, owner))
        self.rows, self.start, self.n_terms = np.array(items.rows, np.int64), items.start, len(items.terms)
        self.term, self.value = items.term[turn], value[turn]
        square = self.value.astype(float) ** 2
        self.length = np.sqrt(np.add.reduceat(square, self.start[:-1])) if len(self.rows) else np.zeros(0)
        # the head of an item: its heaviest terms with three quarters of its square length
        self.head, self.rest = [], []
        for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist()):
            run = np.cumsum(square[a:b])
            k = int(np.searchsorted(run, 0.75 * run[-1])) + 1
            self.head.append(min(k, b - a))
            self.rest.append(math.sqrt(max(run[-1] - run[self.head[-1] - 1], 0.0)))


class Bucket:
    """Documents of similar length: their vectors by document and by term."""

    def __init__(self, ids: np.ndarray, square: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.ids, self.square, self.n = ids, square, len(ids)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.impact = term, impact
        doc = np.repeat(np.arange(self.n), sizes)
        turn = np.argsort(term, kind="stable")
        self.by_term, self.doc, self.values = term[turn], doc[turn], impact[turn]
        self.heads = np.flatnonzero(np.concatenate([[True], self.by_term[1:] != self.by_term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.held = self.by_term[self.heads]
        self.ends = np.append(self.heads[1:], len(term))
        self.most = np.maximum.reduceat(self.values, self.heads) if len(term) else np.zeros(0, np.int64)

    def search(self, query: Query, heaps: dict[int, list], floor: np.ndarray) -> None:
        """Offer each item's documents that may be among its best; raises `floor`, the thresholds."""
        longest = math.sqrt(float(self.square.max(initial=0)))
        most = np.zeros(query.n_terms, np.int64)
        most[self.held] = self.most
        place = np.full(query.n_terms, -1)
        place[self.held] = np.arange(len(self.held))
        live = query.length * longest * SAFE >= floor  # 1
        reach = np.add.reduceat(query.value * most[query.term], query.start[:-1])
        live &= (reach >= floor) & (reach > 0)  # 2
        for i in np.flatnonzero(live).tolist():
            a = query.start[i]
            groups = place[query.term[a:a + query.head[i]]]
            value = query.value[a:a + query.head[i]][groups >= 0]
            groups = groups[groups >= 0]
            at = _ranges(self.heads[groups], self.ends[groups])
            sizes = (self.ends - self.heads)[groups]
            docs, impact = self.doc[at], self.values[at].astype(float)
            head = np.bincount(docs, impact * np.repeat(value, sizes), self.n)
            known = np.bincount(docs, impact * impact, self.n)
            rest = query.rest[i] * np.sqrt(np.maximum(self.square * SAFE - known, 0.0))
            kept = np.flatnonzero((head + rest) * SAFE >= max(floor[i], 1))  # 3
            if len(kept):
                self._offer(query, i, kept, heaps, floor)

    def _offer(self, query: Query, i: int, kept: np.ndarray, heaps: dict[int, list], floor: np.ndarray) -> None:
        a, b = query.start[i], query.start[i + 1]
        weight = np.zeros(query.n_terms, np.int64)
        weight[query.term[a:b]] = query.value[a:b]
        at = _ranges(self.start[kept], self.start[kept + 1])
        sums = np.concatenate([[0], np.cumsum(weight[self.term[at]] * self.impact[at])])  # 4
        ends = np.cumsum(self.start[kept + 1] - self.start[kept])
        score = sums[ends] - sums[ends - (self.start[kept + 1] - self.start[kept])]
        good = np.flatnonzero((score > 0) & (score >= floor[i]))
        if len(good) > BEST:
            good = good[np.lexsort((self.ids[kept[good]], -score[good]))[:BEST]]
        best = heaps.setdefault(i, [])
        best += zip((-score[good]).tolist(), self.ids[kept[good]].tolist())
        best.sort()
        del best[BEST:]
        if len(best) == BEST:
            floor[i] = max(floor[i], -best[-1][0])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


_COUNTED = "doc_id long, n long, term binary, tf binary"


def _count_batches(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    """Of each document with a term: how many it has, and how often it has the queries' terms."""
    known = terms.value
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            columns: list[list] = [[], [], [], []]
            for doc, text in zip(batch_of(part, "doc_id").to_pylist(), as_bytes(batch_of(part, "text"))):
                words = words_of(text)
                if words:
                    counts = Counter(words)
                    held = [(known[w], n) for w, n in counts.items() if w in known]
                    pairs = np.array(held, np.int64).reshape(-1, 2)
                    for column, x in zip(columns, (doc, len(words), pairs[:, 0].astype("<u4").tobytes(), pairs[:, 1].astype("<u4").tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["doc_id", "n", "term", "tf"])


def _df_batches(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(n_terms, np.int64)
    for batch in batches:
        held = b"".join(batch_of(batch, "term").to_pylist())
        total += np.bincount(np.frombuffer(held, "<u4"), minlength=n_terms)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])


_VECTORS = "doc_id long, square long, term binary, impact binary"


def _impact_batches(batches: Iterator[pa.RecordBatch], n_docs: int, n_words: int) -> Iterator[pa.RecordBatch]:
    """Impact vectors (tf times 10**9 over 1000 tf + 8 m) and their squared lengths."""
    for batch in batches:
        sizes = np.array(pa.compute.binary_length(batch_of(batch, "term")).to_pylist(), np.int64) // 4
        tf = np.frombuffer(b"".join(batch_of(batch, "tf").to_pylist()), "<u4").astype(np.int64)
        m = np.array([100 - 75 + 75 * n * n_docs // n_words for n in batch_of(batch, "n").to_pylist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
        sums = np.concatenate([[0], np.cumsum(impact * impact)])
        ends = np.cumsum(sizes)
        square = sums[ends] - sums[ends - sizes]
        data = impact.astype("<u4").tobytes()
        each = [data[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays([batch_of(batch, "doc_id"), pa.array(square), batch_of(batch, "term"), pa.array(each, pa.binary())],
                                         names=["doc_id", "square", "term", "impact"]).filter(pa.array(square > 0))


_FOUND = "item long, score long, doc_id long"


def _search_batches(batches: Iterator[pa.RecordBatch], query, floor: list[int]) -> Iterator[pa.RecordBatch]:
    query, floor, heaps = query.value, np.array(floor, np.int64), {}
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET_DOCS):
            b = batch.slice(at, BUCKET_DOCS)
            sizes = np.array(pa.compute.binary_length(batch_of(b, "term")).to_pylist(), np.int64) // 4
            term, impact = (np.frombuffer(b"".join(batch_of(b, c).to_pylist()), "<u4").astype(np.int64) for c in ("term", "impact"))
            ids = batch_of(b, "doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            Bucket(ids, batch_of(b, "square").to_numpy(zero_copy_only=False), sizes, term, impact).search(query, heaps, floor)
    rows = [(int(query.rows[i]), -score, None if doc == NULL_ID else doc) for i, best in heaps.items() for score, doc in best]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "score", "doc_id"])


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(words_of(t)) for t in as_bytes(batch_of(batch, "text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["item", "item_id", "text", "n"])


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    """The items in blocks, fetched one after the other."""
    rows, total = [], 0
    for item, text, n in items.where("n > 0").orderBy("item").select("item", "text", "n").toLocalIterator():
        if rows and total + n > block_terms:
            yield Items(rows)
            rows, total = [], 0
        rows.append((item, words_of(text.encode())))
        total += n
    if rows:
        yield Items(rows)


def _search_block(docs: DataFrame, items: Items, best: int) -> DataFrame:
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(items.terms)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    counted = store(rows.mapInArrow(partial(_count_batches, terms=terms), _COUNTED), "term-counts")
    terms.destroy()
    n_docs, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block at most
    held = (counted.select("term").mapInArrow(partial(_df_batches, n_terms=len(items.terms)), "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(len(items.terms), np.int64)
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    query = spark.sparkContext.broadcast(Query(items, weights(df, n_docs)))
    vectors = store(counted.mapInArrow(partial(_impact_batches, n_docs=n_docs, n_words=max(n_words, 1)), _VECTORS), "impacts")
    place = {row: i for i, row in enumerate(items.rows)}
    floor = [0] * len(place)
    seeds = vectors.orderBy(F.desc("square")).limit(SEED_DOCS)
    first = _best(seeds.mapInArrow(partial(_search_batches, query=query, floor=floor), _FOUND), BEST)
    for item, score in first.where(F.col("rank") == BEST).select("item", "score").toLocalIterator():
        floor[place[item]] = score
    ordered = vectors.repartitionByRange(F.desc("square"), F.xxhash64("doc_id", "term")).sortWithinPartitions(F.desc("square"))
    found = ordered.mapInArrow(partial(_search_batches, query=query, floor=floor), _FOUND)
    result = store(_best(found, best), "found")
    query.destroy()
    return result


def _best(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, benchmark: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item and rank: item_id, rank, doc_id, score of its ten highest-scoring documents."""
    spark: SparkSession = docs.sparkSession
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    kinds = f"item long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, text string, n long"
    items = store(numbered.mapInArrow(_item_batches, kinds), "items")
    found = spark.createDataFrame([], _FOUND + ", rank int")
    for block in _blocks(items, block_terms):
        found = found.union(_search_block(docs, block, BEST))
    return items.join(found, "item").select("item_id", "rank", "doc_id", "score")
