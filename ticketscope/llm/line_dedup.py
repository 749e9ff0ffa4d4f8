"""Line deduplication over an index that can be extended and taken back.

The index has three stored tables:
* members (hi, lo, doc): the 128-bit key hash of every line key of a document, once per document
  row; the exact base for taking documents out again;
* refs (hi, lo, n_rows, min_doc, max_doc): the exact reference count of each key;
* filters (shard, filter): a cuckoo filter per shard over the keys that several documents share.
  A key enters its filter when a second document brings it and is deleted from the filter when
  the last but one leaves.

Documents are deduplicated in two steps: the filter of its shard lets a line pass only if it may be
shared (most lines end here), and the exact table decides on the rest. A filter that can't hold
another key lets everything pass, so no shared line is ever missed. Rows meet filters by shard and
salt, so a line that a third of the documents hold is dealt over several tasks.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; keys of under
`min_chars` code points never count. A shared key loses its lines in every document but the
smallest doc_id that holds it. A null or empty text is one empty line. Rows that repeat a doc_id
are one document; a null doc_id is one document that sorts last. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import as_bytes, batch_of, store

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 14
SALT_ROWS = 1 << 19  # members of a shard that one task reads
_BLANK = b" \t\n\x0b\x0c\r"
_LAST = 2**63 - 1  # stands for a null doc_id
_MEMBERS = "hi long, lo long, doc long"
_REFS = "hi long, lo long, n_rows long, min_doc long, max_doc long"
_FILTERS = "shard int, filter binary"


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    key = line.strip(_BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _member_batches(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes, counts = batch_of(b, "doc").to_numpy(), [], []
        for text in as_bytes(batch_of(b, "text")):
            keys = {h for line in (text or b"").split(b"\n") if (h := key_hash(line, min_chars))}
            hashes += keys
            counts.append(len(keys))
        both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids, counts))],
            names=["hi", "lo", "doc"])


def member_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    return rows.mapInArrow(partial(_member_batches, min_chars=min_chars), _MEMBERS)


class CuckooFilter:
    """Buckets of four 16-bit tags; a key's tag lies in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray, full: bool = False) -> None:
        self.table, self.full, self.mask = table, full, len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, math.ceil(math.log2(max(1, keys) / (cls.SLOTS * 0.8))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16, offset=1).reshape(-1, cls.SLOTS).copy(), data[0] == 1)

    def dump(self) -> bytes:
        return bytes([self.full]) + self.table.tobytes()

    def places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag and both buckets of keys."""
        lo = lo.astype(np.int64).view(np.uint64)
        tag = ((lo >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        one = (lo & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask
        return tag, one, one ^ self._hop(tag)

    def _hop(self, tag):
        return (tag * 0x5BD1E995 >> 7) & self.mask

    def contains(self, lo: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(lo), bool)
        tag, one, two = self.places(lo)
        return ((self.table[one] == tag[:, None]) | (self.table[two] == tag[:, None])).any(axis=1)

    def insert(self, lo: np.ndarray) -> None:
        rng = np.random.default_rng(0)
        for tag, one, two in zip(*(p.tolist() for p in self.places(lo))):
            if self.full:
                return
            if self._put(tag, one) or self._put(tag, two):
                continue
            at = one
            for _ in range(self.KICKS):
                slot = int(rng.integers(self.SLOTS))
                tag, self.table[at, slot] = int(self.table[at, slot]), tag
                at ^= int(self._hop(tag))
                if self._put(tag, at):
                    break
            else:
                self.full = True

    def _put(self, tag: int, at: int) -> bool:
        row = self.table[at]
        for slot in range(self.SLOTS):
            if row[slot] == 0:
                row[slot] = tag
                return True
        return False

    def delete(self, lo: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for tag, one, two in zip(*(p.tolist() for p in self.places(lo))):
            for at in (one, two):
                slots = np.flatnonzero(self.table[at] == tag)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    break


def _update_filter(key, old: pa.Table, changes: pa.Table, keys: int) -> pa.Table:
    """The filter of a shard after insertions (enters) and deletions."""
    f = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.sized(max(keys, changes.num_rows))
    if changes.num_rows:
        lo, enters = changes["lo"].to_numpy(), changes["enters"].to_numpy().astype(bool)
        if not f.full:
            f.delete(lo[~enters])
        f.insert(lo[enters])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


def _screen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt), the filter first: lets members pass that may be shared."""
    now, current = None, None
    for b in batches:
        shard, salt = (batch_of(b, c).to_numpy() for c in ("shard", "salt"))
        if not len(shard):
            continue
        data, lo = batch_of(b, "filter"), np.ascontiguousarray(batch_of(b, "lo").to_numpy(zero_copy_only=False))
        passes = np.zeros(len(shard), bool)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            if (shard[start], salt[start]) != now:
                now, current = (shard[start], salt[start]), None
            while start < end and data[start].is_valid:
                current = CuckooFilter.load(data[start].as_py())
                start += 1
            if current is not None and start < end:  # a shard without a filter has no shared key
                passes[start:end] = current.contains(lo[start:end].astype(np.int64))
        yield b.select(["hi", "lo", "doc"]).filter(pa.array(passes))


def _apply_batches(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, dropped in zip(as_bytes(batch_of(b, "text")), batch_of(b, "dropped").to_pylist()):
            lines = (text or b"").split(b"\n")
            kept = lines
            if dropped:
                out = {np.array(pair, np.int64).tobytes() for pair in zip(dropped[::2], dropped[1::2])}
                kept = [x for x in lines if key_hash(x, min_chars) not in out]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        n, gone, texts = list(zip(*rows)) or ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch_of(b, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(texts, pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


@dataclass
class LineIndex:
    members: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = MIN_CHARS) -> LineIndex:
        return cls(*(spark.createDataFrame([], s) for s in (_MEMBERS, _REFS, _FILTERS)), 0, min_chars)

    def _shard(self, shards: int):
        return F.pmod("hi", F.lit(max(1, shards))).cast("int")

    def _next(self, members: DataFrame, refs: DataFrame) -> LineIndex:
        """The index over new members and reference counts, its filters updated by the keys that
        became shared or stopped being so. Filters are built anew when shards have outgrown their size."""
        shared = refs.filter("min_doc < max_doc")
        n = shared.count()
        shards = max(1, math.ceil(n / KEYS_PER_SHARD))
        before, old = self.refs.filter("min_doc < max_doc"), self.filters
        if self.shards and shards <= 2 * self.shards:
            shards = self.shards
            enters = shared.join(before, ["hi", "lo"], "left_anti").withColumn("enters", F.lit(True))
            leaves = before.join(shared, ["hi", "lo"], "left_anti").withColumn("enters", F.lit(False))
            changes = enters.select("hi", "lo", "enters").union(leaves.select("hi", "lo", "enters"))
        else:
            changes = shared.select("hi", "lo", F.lit(True).alias("enters"))
            old = old.limit(0)
        keyed = changes.withColumn("shard", self._shard(shards)).groupBy("shard")
        filters = old.groupBy("shard").cogroup(keyed).applyInArrow(
            partial(_update_filter, keys=2 * KEYS_PER_SHARD), _FILTERS)
        return LineIndex(members, refs, store(filters, "line-filters"), shards, self.min_chars)

    @staticmethod
    def _counts(members: DataFrame) -> DataFrame:
        return members.groupBy("hi", "lo").agg(F.count("*").alias("n_rows"), F.min("doc").alias("min_doc"),
                                               F.max("doc").alias("max_doc"))

    def insert(self, docs: DataFrame) -> LineIndex:
        added = store(member_rows(docs, self.min_chars), "line-members")
        refs = self._counts(added)
        if self.shards:
            refs = self.refs.union(refs).groupBy("hi", "lo").agg(
                F.sum("n_rows").alias("n_rows"), F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"))
        return self._next(self.members.union(added) if self.shards else added, store(refs, "line-refs"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out; lines that they alone had made duplicates come back."""
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")).distinct()
        left = store(self.members.join(gone, "doc", "left_anti").select("hi", "lo", "doc"), "line-members")
        touched = self.members.join(gone, "doc", "left_semi").select("hi", "lo").distinct()
        counted = self._counts(left.join(touched, ["hi", "lo"], "left_semi"))
        refs = self.refs.join(touched, ["hi", "lo"], "left_anti").unionByName(counted)
        return self._next(left, store(refs, "line-refs"))

    def drops(self, members: DataFrame) -> DataFrame:
        """(doc, hi, lo) of the lines to drop."""
        placed = members.withColumn("shard", self._shard(self.shards))
        # one row per shard: how many tasks read its members, a line in many documents among them
        sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts"))
        sizes = store(sizes, "line-salts")
        salted = (placed.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).drop("salts")
                  .withColumn("filter", F.lit(None).cast("binary")))
        ahead = self.filters.join(sizes, "shard").select(
            F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("doc"),
            "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")
        maybe = (ahead.unionByName(salted).repartition("shard", "salt")
                 .sortWithinPartitions("shard", "salt", F.col("filter").isNull())
                 .mapInArrow(_screen_batches, _MEMBERS))
        exact = self.refs.filter("min_doc < max_doc").select("hi", "lo", "min_doc")
        return maybe.join(exact, ["hi", "lo"]).filter("doc > min_doc").select("doc", "hi", "lo")

    def dedup(self, docs: DataFrame, members: DataFrame | None = None) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text, kept_sha256) per row of documents that were
        inserted; `members` are their rows if they are at hand."""
        rows = members if members is not None else member_rows(docs, self.min_chars)
        pair = F.array("hi", "lo")
        by_doc = self.drops(rows).groupBy("doc").agg(F.flatten(F.collect_set(pair)).alias("dropped"))
        keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"))
        schema = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
        return (keyed.join(by_doc, "doc", "left").select(F.col("doc_id").cast("long"), "text", "dropped")
                .mapInArrow(partial(_apply_batches, min_chars=self.min_chars), schema))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Deduplicates a whole table: every document enters the index, then is read against it."""
    index = LineIndex.empty(docs.sparkSession, min_chars).insert(docs)
    return index.dedup(docs, index.members)
