"""Benchmark decontamination with suffix arrays over the training text.

Every task builds, for each shard of whole documents, the suffix array of its words (prefix
doubling, sorted as deep as the longest benchmark item). All suffixes of the benchmark are binary
searched in it: the interval of suffixes that begin with an item's window gives every place of the
window. The places found put the benchmark's suffixes among the shard's in one order; every suffix
of the shard matches furthest with the nearest of them before or after it, so every document has
its longest verbatim match, however many documents hold the same passage. Words are numbered
within a shard, so a match is one of words, not of hashes.

Of a document's matches of most words the first in the text is reported, and of the items that
hold it the one with the least name: how rows fall into shards and blocks changes nothing.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
window. A word inside any occurrence of a window is hit. A document is contaminated if it has a
hit word and 20 * n_hit >= n_words (the ratio is a parameter).

The benchmark goes to the tasks in blocks of at most `block_words` words, each broadcast on its
own and searched one after the other. Tasks hold all blocks, so a benchmark of over `most_bytes`
bytes of text is an error (raise the bound with the workers' memory, or run parts of the benchmark
one after the other); it is checked before anything is broadcast. Shards hold at most `shard_words`
words unless a single document is longer; the number of documents isn't limited.

A null or blank text has no words and is clean. Null or blank items match nothing. Rows that
repeat a doc_id or an item_id count each as a row; a repeated item_id is listed once; a null
item_id is listed as "null". An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.llm.common import as_bytes, batch_of, hands_back, slices

WINDOW = 13
RATIO = 20
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20
MOST_BYTES = 32 << 20

# Word bytes: ASCII letters and digits and every byte of a character beyond ASCII.
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

_OTHER = 2**32 - 1  # number of benchmark words that are not in the shard

REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_words", T.LongType()), T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLASS).split() if text else []


def _codes(code, words: list[bytes], *more) -> np.ndarray:
    """The numbers that `code` gives the words; 0 is left for document ends."""
    return np.fromiter(map(code, words, *more), np.int64, len(words)).astype(np.uint64)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` codes at least."""
    n = len(codes)
    key = (codes << np.uint64(32)) | np.concatenate([codes[1:], np.zeros(1, np.uint64)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the empty suffix sorts first
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    done = 2
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # places whose group has several
    while done < depth and len(tied):
        at = order[tied]
        group, after = rank[at], rank[np.minimum(at + done, n)]
        turn = np.lexsort((after, group))
        at, group, after = at[turn], group[turn], after[turn]
        order[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = first
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        done *= 2
    return order


class Block:
    """Some benchmark items: their words, and where their windows start."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.rank = np.empty(len(items), np.int64)  # place of each item's name among the names
        self.rank[sorted(range(len(items)), key=self.names.__getitem__)] = np.arange(len(items))
        self.words = [w for _, ws in items for w in ws]
        lengths = np.array([len(ws) for _, ws in items], np.int64)
        ends = np.cumsum(lengths)
        self.item = np.repeat(np.arange(len(items)), lengths)
        self.start = np.arange(len(self.words))
        self.left = ends[self.item] - self.start  # words from here to the item's end
        self.depth = int(lengths.max(initial=0))
        whole = self.left >= window
        short = (lengths[self.item] < window) & (self.left == lengths[self.item])
        self.windows = np.flatnonzero(whole | short)
        self.sizes = np.minimum(self.left[self.windows], window)

    def search(self, codes: np.ndarray, order: np.ndarray, own: np.ndarray, starts: np.ndarray,
               sizes: np.ndarray, upper: bool) -> np.ndarray:
        """For each test suffix, cut to its size, the number of training suffixes before it (or,
        with `upper`, before or beginning with it)."""
        n = len(codes)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            at, test, size = order[mid], starts[open_], sizes[open_]
            goes_up = np.full(len(open_), upper)  # what holds if all words agree
            live = np.arange(len(open_))
            step = 0
            while len(live):
                place = at[live] + step
                here = np.where(place < n, codes[np.minimum(place, n - 1)], 0)
                there = own[test[live] + step]
                differ = here != there
                goes_up[live[differ]] = here[differ] < there[differ]
                live = live[~differ]
                step += 1
                live = live[size[live] > step]
            low[open_] = np.where(goes_up, mid + 1, low[open_])
            high[open_] = np.where(goes_up, high[open_], mid)

    def agree(self, codes: np.ndarray, own: np.ndarray, at: np.ndarray, test: np.ndarray) -> np.ndarray:
        """Words in common of each test suffix and the training suffix at `at` (-1: none)."""
        n, same = len(codes), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at >= 0)
        step = 0
        while len(live):
            place = at[live] + step
            ok = (place < n) & (codes[np.minimum(place, n - 1)] == own[test[live] + step])
            live = live[ok]
            same[live] += 1
            step += 1
            live = live[self.left[test[live]] > step]
        return same

    def longest(self, codes: np.ndarray, order: np.ndarray, own: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        """(document, words, place in the shard, item name) of the longest match of each document
        that has one."""
        n = len(order)
        place = self.search(codes, order, own, self.start, self.left, upper=False)
        before = self.agree(codes, own, np.where(place > 0, order[np.maximum(place - 1, 0)], -1), self.start)
        after = self.agree(codes, own, np.where(place < n, order[np.minimum(place, n - 1)], -1), self.start)
        # Of the test suffixes at one place, the last in order agrees most with what follows, the
        # first with what comes before.
        spots, first = np.unique(np.sort(place), return_index=True)
        last_here = np.lexsort((-after, place))[first]
        first_here = np.lexsort((-before, place))[first]
        spot = np.searchsorted(spots, np.arange(n), side="right")  # test places up to each training suffix
        ats, sames = [], []
        for some, test in ((np.flatnonzero(spot > 0), last_here[spot[spot > 0] - 1]),
                           (np.flatnonzero(spot < len(spots)), first_here[spot[spot < len(spots)]])):
            at = order[some]
            # a match that goes on to the left is part of a longer one, a word earlier
            inner = ((at > 0) & (self.start[test] > 0) & (self.item[test] == self.item[np.maximum(test - 1, 0)])
                     & (codes[np.maximum(at - 1, 0)] == own[np.maximum(test - 1, 0)]))
            at, test = at[~inner], test[~inner]
            same = self.agree(codes, own, at, test)
            ats.append(at[same > 0])
            sames.append(same[same > 0])
        at, same = np.concatenate(ats), np.concatenate(sames)
        doc = np.searchsorted(starts, at, side="right") - 1
        turn = np.lexsort((at, -same, doc))
        doc, first = np.unique(doc[turn], return_index=True)
        at, same = at[turn][first], same[turn][first]
        # the items that hold the match: test suffixes next to a training suffix that begins with it
        low = self.search(codes, order, codes, at, same, upper=False)
        high = self.search(codes, order, codes, at, same, upper=True)
        turn = np.argsort(place, kind="stable")
        least, greatest = np.searchsorted(place[turn], low), np.searchsorted(place[turn], high, side="right")
        known: dict[tuple[int, int], str] = {}
        for d, size, a, lo, hi, i, j in zip(*(v.tolist() for v in (doc, same, at, low, high, least, greatest))):
            if (lo, size) not in known:
                q = turn[i:j]
                q = q[((after[q] >= size) & (place[q] < hi)) | ((before[q] >= size) & (place[q] > lo))]
                items = self.item[q]
                known[lo, size] = self.names[items[self.rank[items].argmin()]]
            yield d, size, a, known[lo, size]


def _occurrences(block: Block, order: np.ndarray, starts: np.ndarray, low: np.ndarray,
                 high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the shard lie in an occurrence of a window, and the (document, item) pairs.

    Equal windows share one interval of the suffix array and are worked on once; the intervals of
    one size don't overlap, so there are at most as many occurrences a size as words."""
    found = np.flatnonzero(high > low)
    n = len(order)
    owner = block.item[block.windows[found]]
    keys, first, which = np.unique(low[found] * (n + 1) + block.sizes[found], return_index=True, return_inverse=True)
    low, high, sizes = low[found][first], high[found][first], block.sizes[found][first]
    counts = high - low
    ends = np.cumsum(counts)
    at = order[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - counts), counts)]
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + np.repeat(sizes, counts), minlength=n + 1)
    docs = np.searchsorted(starts, at, side="right") - 1
    seen = np.unique(np.repeat(np.arange(len(keys)), counts) * len(starts) + docs)  # (interval, document)
    interval, docs = seen // len(starts), seen % len(starts)
    held = np.unique(which * len(block.names) + owner)  # (interval, item)
    begin = np.searchsorted(held, np.arange(len(keys) + 1) * len(block.names))
    many = (begin[1:] - begin[:-1])[interval]
    upto = np.cumsum(many)
    item = held[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin[:-1][interval] - (upto - many), many)] % len(block.names)
    pairs = np.unique(np.repeat(docs, many) * len(block.names) + item)
    return np.cumsum(change[:n]) > 0, np.stack([pairs // len(block.names), pairs % len(block.names)], axis=1)


def _search_shard(texts: list[bytes | None], blocks: list, window: int) -> Iterator[tuple]:
    docs = [words_of(t) for t in texts]
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    flat: list[bytes] = []
    for d in docs:
        flat += d
        flat.append(b"")
    numbers = defaultdict(count(1).__next__)
    codes = _codes(numbers.__getitem__, flat)
    codes[starts + lengths] = 0
    hit = np.zeros(len(flat), bool)
    items: list[set[str]] = [set() for _ in docs]
    best: list[tuple[int, int, str | None]] = [(0, -1, None)] * len(docs)
    order = depth = None
    for handle in blocks:
        block: Block = handle.value
        if not len(block.words) or not len(flat):
            continue
        if order is None or block.depth > depth:
            depth = max(block.depth, window)
            order = suffix_array(codes, depth)
        own = _codes(numbers.get, block.words, repeat(_OTHER))
        for d, n, a, name in block.longest(codes, order, own, starts):
            a -= int(starts[d])
            if n > best[d][0] or n == best[d][0] and (a, name) < best[d][1:]:
                best[d] = (n, a, name)
        low = block.search(codes, order, own, block.windows, block.sizes, upper=False)
        high = block.search(codes, order, own, block.windows, block.sizes, upper=True)
        marks, pairs = _occurrences(block, order, starts, low, high)
        hit |= marks
        for d, i in pairs.tolist():
            items[d].add(block.names[i])
    n_hit = np.add.reduceat(hit, starts, dtype=np.int64) if len(flat) else []
    for d, n in enumerate(lengths.tolist()):
        yield n, int(n_hit[d]), sorted(items[d]), *best[d]


@hands_back
def _report_batches(batches: Iterator[pa.RecordBatch], blocks: list, window: int, ratio: int,
                    shard_words: int, keep: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                        ("items", pa.list_(pa.string())), ("longest_words", pa.int64()),
                        ("longest_at", pa.int64()), ("longest_item", pa.string()),
                        ("contaminated", pa.bool_())])
    for batch in batches:
        for part in slices(batch, "text", shard_words * 6):
            found = list(_search_shard(as_bytes(batch_of(part, "text")), blocks, window))
            dirty = [hit > 0 and ratio * hit >= n for n, hit, *_ in found]
            if keep:
                yield part.filter(pa.array([not d for d in dirty], pa.bool_()))
            else:
                columns = [batch_of(part, "doc_id").to_pylist(), *map(list, zip(*found)), dirty]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(benchmark: DataFrame, window: int, block_words: int, most_bytes: int) -> list:
    """Broadcasts of at most `block_words` words each, unless a single item has more."""
    size = benchmark.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; most_bytes is {most_bytes}")
    context, out, items, total = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(row[1].encode() if row[1] is not None else None)
        if items and total + len(words) > block_words:
            out.append(context.broadcast(Block(items, window)))
            items, total = [], 0
        if words:
            items.append((row[0] if row[0] is not None else "null", words))
            total += len(words)
    if items:
        out.append(context.broadcast(Block(items, window)))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO,
           shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
           most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: its words, those hit, the items found, the longest verbatim match (words,
    place in the document, item) and whether it is contaminated."""
    run = partial(_report_batches, blocks=_blocks(benchmark, window, block_words, most_bytes), window=window,
                  ratio=ratio, shard_words=shard_words, keep=False)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO,
                        shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
                        most_bytes: int = MOST_BYTES) -> DataFrame:
    """The clean documents, all columns."""
    run = partial(_report_batches, blocks=_blocks(benchmark, window, block_words, most_bytes), window=window,
                  ratio=ratio, shard_words=shard_words, keep=True)
    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
