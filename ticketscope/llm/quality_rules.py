"""Quality rules with adaptive thresholds from mergeable quantile sketches.

1. One pass measures every whole text (counts and rates).
2. Each rate goes to a logarithmic bucket; bucket counts per (lang, source, rate) are the quantile
   sketch. Counts add up, so sketches merge exactly in any order, over tasks, sources and
   languages, and a quantile is right within `ACCURACY` of its value.
3. The sketch of each (lang, source) is merged with those of its language and of all rows, each
   weighing as much as `prior_docs` rows: a large source has its own thresholds, a small one those of
   what is around it, and they change smoothly with its size. Weights are whole numbers (a count
   times the sizes of the other groups), so the result is exact in any order.
   The fences of a rate are quartile +- `reach` times the quartile distance (at least the rate's
   least spread).
4. The measured rows are joined with the thresholds of their group and judged.

Null texts count as empty: no words, so they fail the base rule. A null lang or source is a group
of its own. Rows that repeat a doc_id are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.llm.common import as_bytes, batch_of, store

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
ACCURACY = 0.01
LEAST = 1e-4  # smaller rates share one bucket
PRIOR_DOCS = 200
REACH = 4.0

#: rate -> (numerator, denominator, added to the denominator, least spread, lower fence too).
#: What is added keeps a single odd line or word of a short text from making a rate high.
RATES = {
    "symbols_per_word": ("n_symbols", "n_words", 20, 0.04, False),
    "dup_lines_per_line": ("n_dup_lines", "n_lines", 15, 0.03, False),
    "repeats_per_word": ("n_repeat_words", "n_words", 100, 0.05, False),
    "chars_per_word": ("word_chars", "n_words", 0, 0.4, True),
    "shouts_per_word": ("n_shouts", "n_words", 20, 0.06, False),
    "marks_per_word": ("n_marks", "n_words", 20, 0.06, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_shouts", "n_marks"]


def repeat_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words inside `size`-word windows that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twin = np.append(same, False) | np.insert(same, 0, False)
    seen: dict[tuple, int] = {}
    starts = []
    for at in order[twin].tolist():  # equal codes are confirmed word by word
        window = tuple(words[at:at + size])
        first = seen.setdefault(window, at)
        if first != at:
            starts += [first, at]
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.array(starts, np.int64))
    cover[starts] += 1
    cover[starts + size] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or b""
    words = text.split()  # splits on 20 and 09-0D alone
    chars = sum(map(len, words))
    if not text.isascii():
        chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    repeated = 0
    for line in lines:
        if line in seen:
            repeated += bool(line.split(None, 1))
        else:
            seen.add(line)
    return (len(words), chars, sum(map(text.count, SYMBOLS.encode())), repeated, repeat_words(words),
            len(lines), sum(map(bytes.isupper, words)), text.count(b"!"))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = list(zip(*map(measure, as_bytes(batch_of(b, "text"))))) or [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*(batch_of(b, c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in counts)],
            names=["doc_id", "lang", "source", *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", "source")
    schema = T.StructType([rows.schema[c] for c in ("doc_id", "lang", "source")]
                          + [T.StructField(c, T.LongType()) for c in COUNTS])
    return rows.mapInArrow(_measure_batches, schema)


def _rate(name: str):
    top, bottom, more, *_ = RATES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / (F.col(bottom) + more)).otherwise(F.lit(0.0))


_LOG_STEP = math.log((1 + ACCURACY) / (1 - ACCURACY))
_LOWEST = math.floor(math.log(LEAST) / _LOG_STEP)


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, docs): a mergeable quantile sketch per lang, source and rate."""
    def bucket(value):
        return F.when(value < LEAST, F.lit(_LOWEST)).otherwise(F.ceil(F.log(value) / _LOG_STEP)).cast("int")
    pairs = F.array(*(F.struct(F.lit(n).alias("rate"), bucket(_rate(n)).alias("bucket")) for n in RATES))
    # inline, then a partial aggregate: a hot source costs one row per task, rate and bucket
    return (rows.select("lang", "source", F.inline(pairs))
            .groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("docs")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "rate", "bucket").agg(F.sum("docs").alias("docs"))


def blended(sketches: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """(lang, source, rate, bucket, weight): each source's sketch with those of its language and of
    all rows. The weight of a bucket is n + prior * l / L + prior * a / A times L * A, for counts n, l
    and a in the source, the language (of L rows) and all rows (A)."""
    def whole(c):
        return F.col(c).cast("decimal(12,0)")
    by_lang, every = merge(sketches, ["lang"]), merge(sketches, [])
    sizes = {"l": by_lang.groupBy(F.col("lang").alias("of_lang"), F.col("rate").alias("of_rate")).agg(F.sum("docs").alias("size_l")),
             "a": every.groupBy(F.col("rate").alias("all_rate")).agg(F.sum("docs").alias("size_a"))}
    groups = sketches.select("lang", "source", "rate").distinct()
    zero = F.lit(0).cast("long")
    near = groups.join(by_lang.withColumnsRenamed({"lang": "of_lang", "rate": "of_rate"}),
                       (F.col("rate") == F.col("of_rate")) & F.col("lang").eqNullSafe(F.col("of_lang")))
    keys = ["lang", "source", "rate", "bucket"]
    parts = (sketches.select(*keys, F.col("docs").alias("n"), zero.alias("l"), zero.alias("a"))
             .union(near.select(*keys, zero, "docs", zero))
             .union(groups.join(every, "rate").select(*keys, zero, zero, "docs")))
    return (parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in "nla"))
            .join(sizes["l"], (F.col("rate") == F.col("of_rate")) & F.col("lang").eqNullSafe(F.col("of_lang")))
            .join(sizes["a"], F.col("rate") == F.col("all_rate"))
            .select(*keys, (whole("n") * whole("size_l") * whole("size_a")
                               + prior_docs * (whole("l") * whole("size_a") + whole("a") * whole("size_l")))
                    .cast("decimal(38,0)").alias("weight")))


def quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float], weight: str = "docs") -> DataFrame:
    """Per group and rate a column per share, from (by, rate, bucket, weight). Ranks are compared in
    whole numbers."""
    group = Window.partitionBy(*by, "rate")
    ranked = (sketches.withColumn("upto", F.sum(weight).over(group.orderBy("bucket")))
              .withColumn("total", F.sum(weight).over(group)))
    # the middle of a bucket, in relative terms
    value = F.when(F.col("bucket") <= _LOWEST, F.lit(0.0)).otherwise(
        F.exp(F.col("bucket") * _LOG_STEP) * (1 - ACCURACY))
    return (ranked.withColumn("value", value).groupBy(*by, "rate")
            .agg(*(F.min(F.when(k.denominator * F.col("upto") >= k.numerator * F.col("total"), F.col("value"))).alias(name)
                   for name, k in ((name, Fraction(str(share))) for name, share in shares.items()))))


def thresholds(rows: DataFrame, prior_docs: int = PRIOR_DOCS, reach: float = REACH) -> DataFrame:
    """(lang, source, fences): one row per lang and source; fences is a map from rate to (low, high)."""
    own = store(sketch(rows), "quality-sketch")
    least = F.create_map(*(F.lit(x) for n, r in RATES.items() for x in (n, r[3])))
    both = F.col("rate").isin([n for n, r in RATES.items() if r[4]])
    q = quantiles(blended(own, prior_docs), ["lang", "source"], {"q1": 0.25, "q3": 0.75}, "weight").withColumn(
        "wide", reach * F.greatest(F.col("q3") - F.col("q1"), least[F.col("rate")]))
    fence = F.struct(F.when(both, F.col("q1") - F.col("wide")).otherwise(F.lit(-1.0)).alias("low"),
                     (F.col("q3") + F.col("wide")).alias("high"))
    return q.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", fence))).alias("fences"))


def judge(docs: DataFrame, prior_docs: int = PRIOR_DOCS, reach: float = REACH) -> DataFrame:
    """Per document: its counts, `base_failed`, `kept` and the `broken` rates."""
    rows = store(measured(docs), "quality-measured")
    limits = store(thresholds(rows, prior_docs, reach), "quality-thresholds").select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "fences")
    # `limits` is a stored table: its true size decides whether Spark broadcasts it
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang"))
                       & F.col("source").eqNullSafe(F.col("of_source")), "left")
    outside = [F.when((_rate(n) > F.col("fences")[n]["high"]) | (_rate(n) < F.col("fences")[n]["low"]), F.lit(n))
               for n in RATES]
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (joined.withColumn("broken", F.array_compact(F.array(*outside)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
            .select("doc_id", "lang", "source", *COUNTS, "base_failed", "kept", "broken"))
