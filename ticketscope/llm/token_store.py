"""Token ids in a canonical, length-limited Huffman file format.

Steps: encode every text once and stage the ids; count ids over the whole corpus; build code
lengths from the counts (package-merge, so no code is longer than the limit) and canonical codes
from the lengths; deal the staged ids out by ranges of doc_id, sort, and write.

The format, a folder of two Parquet tables (so any store that Spark writes to will do, and a lost
executor's attempt leaves nothing behind):
* codebook (id, length): the codes follow from it: ascending by (length, id);
* segments (shard, segment, n_ids, doc_ids, lengths, checkpoints, payload): whole documents in
  ascending doc_id order over shard, segment and place. payload is the bit stream of their ids,
  most significant bit first. It is cut in blocks of `BLOCK` ids; checkpoints holds the bit
  offset of each block (little-endian 64-bit), so every block can be decoded by itself.

Decoding reads all blocks of a segment in lockstep, each step one table look-up per block: the
table has an entry for every value of the next `longest code` bits.

A null text is empty and has the end id alone. Null doc_ids come first. Rows that repeat a doc_id
are separate documents, ordered by a hash of their ids, then the ids. An empty table gives an
empty file and result.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import as_bytes, batch_of, hands_back, slices, store
from ticketscope.session import scratch_dir

BLOCK = 256
SEGMENT_IDS = 1 << 20
CODE_BITS = 20
CACHE_WORDS = 600_000
SLICE_BYTES = 4 << 20

# What the fast path takes: ASCII without white space, apostrophe and "<" (special tokens begin
# with it), and Latin-1 letters.
_SIMPLE = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, every other
    byte for the next character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


# What the rules below are written for. A tokenizer file that says anything else is encoded text by
# text with the library alone. Fixed values of the file format:
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None}


def known_rules(path: str) -> bool:
    """Whether a tokenizer file splits and normalises text as WordEncoder's short cuts do."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return (said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _PRE_TOKENIZER
            and all(said["model"].get(k) == v for k, v in _MODEL.items())
            and all(t["content"].startswith("<") and not t["lstrip"] and not t["rstrip"] for t in said.get("added_tokens", [])))


class WordEncoder:
    """From a piece of text without ASCII white space to its ids as little-endian bytes.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its
    pieces one after the other. Simple pieces go straight to the library's BPE model, all others
    through the whole tokenizer. Memory: two generations of at most `limit` / 2 pieces; a piece that
    is met again moves to the younger, and when that is full the older is given up, so frequent
    pieces stay however many rare ones pass.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.alphabet = Tokenizer.from_file(path), limit, _byte_alphabet()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.by_word = known_rules(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self._fresh(piece)
            if len(self.young) >= self.limit // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def _fresh(self, piece: bytes) -> bytes:
        body = piece[:-1] if piece[-1:] in (b".", b",") else piece
        if body.isalpha():  # ASCII letters alone
            low = body.lower()
            if low != piece:
                return self.piece(low) if body is piece else self.piece(low) + self.piece(piece[-1:])
            return self._pack([t.id for t in self.model.tokenize(low.decode())])
        return self._mixed(piece) if piece else b""

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _mixed(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        if not _SIMPLE.fullmatch(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        low = text.lower()
        parts = _PIECES.findall(low)
        if len(parts) > 1 or low != text:
            return b"".join([self.piece(p.encode()) for p in parts])
        word = piece.decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.model.tokenize(word)])

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._pack(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return b"".join(map(self.piece, text.split()))

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text and the end id. Each distinct piece is looked up once, its ids are
        dealt out by number."""
        end = np.array([end_id], self.dtype).tobytes()
        if not self.by_word:
            return pa.array([self.encode(t) + end for t in as_bytes(texts)], pa.large_binary())
        pieces = pa.compute.ascii_split_whitespace(_simplified(texts))
        counts = pa.compute.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        numbered = pieces.flatten().dictionary_encode()
        each = [self.piece(p) for p in as_bytes(numbered.dictionary)] + [end]
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        known = np.frombuffer(b"".join(each), self.dtype)
        first = np.cumsum(size) - size
        ends = np.cumsum(counts)
        number = np.insert(numbered.indices.to_numpy(zero_copy_only=False), ends, len(each) - 1)
        sizes = size[number]
        upto = np.cumsum(sizes)
        # one entry per id: by far the largest arrays, so of half the width where that will do
        width = np.int32 if max(int(sizes.sum()), len(known)) < 1 << 31 else np.int64
        at = np.repeat((first[number] - (upto - sizes)).astype(width), sizes)
        at += np.arange(len(at), dtype=width)
        bounds = np.concatenate([[0], upto[ends + np.arange(len(ends))]]) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(known[at].tobytes())])


def _simplified(texts: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer distinct pieces: A-Z lower-cased (but where a special token's
    name may begin, which is read as it stands), a full stop or comma between a letter and white
    space set apart."""
    whole = texts.cast(pa.large_string()).fill_null("").take(np.arange(len(texts)))  # not a slice: ascii_lower misplaces those
    low = pa.compute.if_else(pa.compute.match_substring(whole, "<|"), whole, pa.compute.ascii_lower(whole))
    return pa.compute.replace_substring_regex(low, r"([a-z])([.,])([ \n])", r"\1 \2\3")


_ENCODERS: dict[str, WordEncoder] = {}  # one per tokenizer file and worker, of bounded size


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@hands_back
def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for b in slices(batch, "text", SLICE_BYTES):
            ids = enc.encode_all(batch_of(b, "text"), end_id).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch_of(b, "doc_id"), ids], names=["doc_id", "ids"])


def stage_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): every whole text, encoded, with the end id; a stored table."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    encoded = rows.mapInArrow(partial(_encode_batches, path=tokenizer_path, end_id=end_id), "doc_id long, ids binary")
    path = scratch_dir(docs.sparkSession, "token-ids")
    encoded.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(encoded.schema).parquet(path)


@hands_back
def _count_batches(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in (part for batch in batches for part in slices(batch, "ids", SLICE_BYTES)):
        n = np.bincount(np.frombuffer(b"".join(batch_of(b, "ids").to_pylist()), dtype))
        if len(n) > len(total):
            total = np.append(total, np.zeros(len(n) - len(total), np.int64))
        total[:len(n)] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge). Counts must be positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, math.ceil(math.log2(n)))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, []
    for _ in range(limit - 1):
        whole = len(row) // 2 * 2
        merged = np.concatenate([leaves, row[:whole:2] + row[1:whole:2]])
        turn = np.argsort(merged, kind="stable")
        is_leaf.append(turn < n)
        row = merged[turn]
    sorted_lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        sorted_lengths[:own] += 1
        take = 2 * (take - own)
    sorted_lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = sorted_lengths
    return out


class Codebook:
    """Canonical codes of ids with given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        room = 1 << (self.longest - self.lengths)  # table entries of each code
        first = np.concatenate([[0], np.cumsum(room)])[:-1]
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (first >> (self.longest - self.lengths)).astype(np.uint64)
        self.length[self.ids] = self.lengths
        self.room = room

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every value of the next `longest` bits."""
        rest = (1 << self.longest) - int(self.room.sum())
        return (np.append(np.repeat(self.ids, self.room), np.zeros(rest, np.int64)).astype(np.uint32),
                np.append(np.repeat(self.lengths, self.room), np.ones(rest, np.int64)))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every block."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        bits = int(ends[-1]) if len(ids) else 0
        word = at >> 5
        value = self.code[ids] << (64 - (at & 31) - lengths).astype(np.uint64)
        n = bits // 32 + 2
        # codes don't overlap, so sums are unions; each is under 2**32 and so exact as a double
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return words.astype(">u4").tobytes()[:(bits + 7) // 8], at[::BLOCK].copy()


def decode(payload: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray],
           longest: int) -> np.ndarray:
    """All blocks at once, a look-up per block and step."""
    symbol, length = table
    words = np.frombuffer(payload + bytes(12 - len(payload) % 4), ">u4").astype(np.uint64)
    at = checkpoints.astype(np.int64).copy()
    blocks = len(at)
    out = np.empty((BLOCK, blocks), np.uint32)
    last = n_ids - (blocks - 1) * BLOCK if blocks else 0
    mask = np.uint64((1 << longest) - 1)
    for i in range(BLOCK if blocks > 1 else last):
        here = at if i < last else at[:-1]
        w = here >> 5
        window = (words[w] << np.uint64(32)) | words[w + 1]
        entry = (window >> (64 - longest - (here & 31)).astype(np.uint64)) & mask
        out[i, :len(here)] = symbol[entry]
        here += length[entry]
    return out.T.reshape(-1)[:n_ids]


@hands_back
def _write_batches(batches: Iterator[pa.RecordBatch], book, dtype: str, segment_ids: int) -> Iterator[pa.RecordBatch]:
    shard, segment = TaskContext.get().partitionId(), 0
    book: Codebook = book.value
    names, parts, total = [], [], 0

    def flush():
        ids = np.concatenate(parts)
        payload, checkpoints = book.encode(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([segment]), pa.array([len(ids)]),
             pa.array([names], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
             pa.array([checkpoints.astype("<u8").tobytes()]), pa.array([payload], pa.binary())],
            names=["shard", "segment", "n_ids", "doc_ids", "lengths", "checkpoints", "payload"])

    for b in batches:
        for doc, ids in zip(batch_of(b, "doc_id").to_pylist(), batch_of(b, "ids").to_pylist()):
            names.append(doc)
            parts.append(np.frombuffer(ids, dtype).astype(np.int64))
            total += len(parts[-1])
            if total >= segment_ids:
                yield flush()
                segment, names, parts, total = segment + 1, [], [], 0
    if parts:
        yield flush()


_SEGMENTS = ("shard long, segment long, n_ids long, doc_ids array<long>, lengths array<long>, "
             "checkpoints binary, payload binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                 code_bits: int = CODE_BITS, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode and write every whole text in ascending doc_id order."""
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path).dtype.str
    staged = stage_ids(docs, tokenizer_path, end_id)
    # one row per id of the vocabulary at most: the tokenizer file bounds what the driver gets
    counts = (staged.select("ids").mapInArrow(partial(_count_batches, dtype=dtype), "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow())
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    lengths = code_lengths(n, code_bits)
    spark.createDataFrame(pa.table({"id": ids, "length": lengths})).coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(Codebook(ids, lengths))
    (staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
     .mapInArrow(partial(_write_batches, book=book, dtype=dtype, segment_ids=segment_ids), _SEGMENTS)
     .write.option("compression", "none").parquet(f"{path}/segments"))


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.schema("id long, length long").parquet(f"{path}/codebook").toArrow()
    return Codebook(rows["id"].to_numpy(), rows["length"].to_numpy())


@hands_back
def _read_batches(batches: Iterator[pa.RecordBatch], book, with_ids: bool) -> Iterator[pa.RecordBatch]:
    book = book.value
    table = book.table()
    for b in batches:
        for row in b.to_pylist():
            ids = decode(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n_ids"], table, book.longest)
            ends = np.cumsum(row["lengths"])
            each = [ids[e - n:e].astype("<u4") for e, n in zip(ends.tolist(), row["lengths"])]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(each)),
                       pa.array([row["segment"]] * len(each)), pa.array(ends - row["lengths"], pa.int64()),
                       pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
            names = ["doc_id", "shard", "segment", "place", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, ids; decoded from the files."""
    book = spark.sparkContext.broadcast(read_codebook(spark, path))
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    schema = "doc_id long, shard long, segment long, place long, n_tokens long, ids_crc32 long"
    rows = segments.mapInArrow(partial(_read_batches, book=book, with_ids=with_ids),
                               schema + (", ids array<long>" if with_ids else ""))
    # running totals: within a shard over its segments, then over shards (one row per written file)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (segments.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
              .select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start")))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
              .join(shards, "shard").select("shard", "segment", (F.col("inside") + F.col("shard_start")).alias("base")))
    starts = store(starts, "segment-starts")  # one row per segment; its size decides on a broadcast
    return rows.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write to a scratch folder, read back."""
    path = scratch_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
