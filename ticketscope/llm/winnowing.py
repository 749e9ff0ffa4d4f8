"""Document fingerprints by winnowing, in DataFrame expressions alone.

Tokens are the runs of characters other than space and the controls 09-0D, cut every `TOKEN_CHARS`
code points (so a text without spaces has tokens as well). Every `k` consecutive tokens, rolled on
one token at a time, have a hash of 32 bits; of every `w` consecutive hashes the least is kept,
the rightmost of equal ones, with its token position. So any run of w + k - 1 tokens that two
texts share gives them a hash in common (`passages` finds where).

A print packs hash and position in one long, hash first and the position reversed: the least of a
window is the least hash, the rightmost first. `hash_of` and `position_of` unpack it.

Fewer than k tokens are one gram, fewer than w grams one window. A null, empty or blank text has
no prints; two texts without prints have likeness 1, with one it is 0. A row's arrays are held in
its task: about 40 bytes a character of the longest text.

`with_next` gives every row the next one in descending doc_id order (null ids last, equal ids by
the text's MD5; after the last row comes the first). Rows are cut into ranges of that order by
bounds from a sample (the bounds change the layout only, never the result), each range is one
window group, and the last row of each range takes the first of the next from a stored table of a
row per range. Copies of one row are spread over ranges by their place in the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import store

TOKEN_CHARS = 16
GRAM = 5
WINDOW = 8
RANGE_ROWS = 1024
MOST_RANGES = 8192
_TOKEN = r"[^\x20\x09-\x0D]{1,%d}" % TOKEN_CHARS
_LAST = 2**31 - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _minima(keys: Column, grams: Column, w: int) -> Column:
    """The least of every w consecutive keys: runs of 2, 4, ... keys up to w, the last two overlapping."""
    def widen(x: Column, have: int) -> Column:
        if have == w:
            return x
        most = min(4, -(-w // have))  # runs of `have` keys to runs of up to 4 times as many
        reach = min(w, have * most)
        steps = [min(have * j, reach - have) for j in range(most)]
        wider = F.transform(F.sequence(F.lit(0), grams - reach), lambda i: F.least(*[x[i + s] for s in steps]))
        return _let(wider, lambda y: widen(y, reach))
    return widen(keys, 1)


def prints(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The prints of a text in order of position: array<long>."""
    def of_words(words: Column) -> Column:
        grams = F.greatest(F.size(words) - (k - 1), F.lit(1))

        def key(i: Column) -> Column:
            high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i, k)), 32), 31)
            return high + (F.lit(_LAST) - i)
        keys = F.transform(F.sequence(F.lit(1), grams), key)
        kept = _let(keys, lambda x: F.when(grams >= w, F.array_distinct(_minima(x, grams, w))).otherwise(F.array(F.array_min(x))))
        return F.when(F.size(words) > 0, kept).otherwise(F.array().cast("array<long>"))
    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0)), of_words)


def hash_of(p: Column) -> Column:
    return F.shiftright(p, 31)


def position_of(p: Column) -> Column:
    """The gram's first token, from 0."""
    return (F.lit(_LAST - 1) - p.bitwiseAND(F.lit(_LAST))).cast("int")


def hashes(p: Column) -> Column:
    """The distinct hashes of an array of prints."""
    return F.array_distinct(F.transform(p, hash_of))


def digest(p: Column) -> Column:
    """One string for an array of prints: SHA-256 of them, in order."""
    return F.sha2(F.array_join(p.cast("array<string>"), ",").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprint_table(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, position, hash): a row per print."""
    return (docs.select(F.col("doc_id").cast("long"), F.explode(prints(F.col("text"), k, w)).alias("p"))
            .select("doc_id", position_of(F.col("p")).alias("position"), hash_of(F.col("p")).alias("hash")))


def passages(docs: DataFrame, queries: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(query_id, doc_id, query_position, position): where documents and a stated set of query
    texts (doc_id, text) share a print. A shared run of w + k - 1 tokens shows at least once."""
    asked = fingerprint_table(queries, k, w).select(F.col("doc_id").alias("query_id"), F.col("position").alias("query_position"), "hash")
    return asked.join(fingerprint_table(docs, k, w), "hash").select("query_id", "doc_id", "query_position", "position")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many (or all) of `following`."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def _order_key() -> Column:
    """A string in whose order rows come: descending doc_id, nulls last, then the text's MD5, then
    a number that spreads copies."""
    flipped = F.bitwise_not(F.col("doc_id")).bitwiseXOR(F.lit(-2**63))
    head = F.when(F.col("doc_id").isNull(), F.lit("1".ljust(17, "0"))).otherwise(
        F.concat(F.lit("0"), F.lpad(F.hex(flipped), 16, "0")))
    spread = F.lpad(F.hex(F.monotonically_increasing_id() % 65536), 4, "0")
    return F.concat(head, F.md5(F.col("text").cast("binary")), spread)


def _range_of(key: Column, bounds: list[str]) -> Column:
    """The number of bounds at or below the key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << j for j in reversed(range(len(bounds).bit_length()))]
    known = F.lit(bounds)

    def halve(at: Column, step: Column) -> Column:
        fits = (at + step <= len(bounds)) & (F.get(known, at + step - 1) <= key)
        return F.when(fits, at + step).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), halve)


def compared(docs: DataFrame, k: int = GRAM, w: int = WINDOW, range_rows: int = RANGE_ROWS,
             most_ranges: int = MOST_RANGES) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint and edited_fingerprint (digests of the prints),
    n_prints, edited_sha256, and the likeness of its prints to the edited text's (near_edited)
    and to the next row's (near_next). One shuffle of the texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", _order_key())
    ranges = max(1, min(-(-rows.count() // range_rows), most_ranges))
    bounds: list[str] = []
    if ranges > 1:  # a sample of keys of bounded size says where ranges end
        sample = sorted(r[0] for r in keyed.select("key").orderBy(F.rand(1)).limit(16 * ranges).toLocalIterator())
        bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
    whole = Window.partitionBy("part").orderBy("key")
    staged = (keyed.withColumn("part", _range_of(F.col("key"), bounds)).repartition("part")
              .withColumn("prints", prints(F.col("text"), k, w))
              .withColumn("next_text", F.lead("text").over(whole))
              .withColumn("next_prints", F.lead("prints").over(whole))
              .withColumn("first", F.row_number().over(whole) == 1))
    last = F.col("next_text").isNull()
    edge = last | F.col("first")
    made = store(_against_next(staged, k, w).select(
        *_COLUMNS, "part", "first", last.alias("last"), F.when(edge, F.col("text")).alias("text"),
        F.when(edge, F.col("prints")).alias("prints")), "neighbours")
    firsts = store(made.where("first").select(
        "part", F.col("text").alias("next_text"), F.col("prints").alias("next_prints")), "firsts")
    # One row per range: the range before each, the last one before the first.
    before = firsts.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    end = firsts.agg(F.max("part")).first()[0]
    links = before.select("part", F.coalesce("before", F.lit(end)).alias("before"))
    ends = (made.where("last").select("doc_id", "text", "prints", F.col("part").alias("before"))
            .join(links, "before").join(firsts, "part"))
    return made.where("not last").select(*_COLUMNS).union(_against_next(ends, k, w).select(*_COLUMNS))


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_prints"]


def _against_next(rows: DataFrame, k: int, w: int) -> DataFrame:
    """Adds the result columns to (text, prints, next_text, next_prints); null without a next row."""
    known = F.col("next_text").isNotNull()
    own = F.col("own_hashes")
    return (rows.withColumn("edited", F.when(known, edited(F.col("text"), F.col("next_text"))))
            .withColumn("edited_prints", F.when(known, prints(F.col("edited"), k, w)))
            .withColumn("own_hashes", hashes(F.col("prints")))
            .withColumns({
                "n_chars": F.length("text").cast("long"),
                "n_prints": F.size("prints").cast("long"),
                "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
                "fingerprint": digest(F.col("prints")),
                "edited_fingerprint": digest(F.col("edited_prints")),
                "near_edited": likeness(own, hashes(F.col("edited_prints"))),
                "near_next": likeness(own, hashes(F.col("next_prints")))}))
