"""The pipeline against its stages done by brute force, and the registered queries."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_simhash_and_mixing import plain_near, plain_targets
from test_text_operators import WORD, plain_report
from ticketscope.llm import quality_model, queries
from ticketscope.llm.common import read_table

SF = "/root/testdata/sf0.001"


def plain_copies(rows):
    """doc_id -> copies taken, from (doc_id, text, source)."""
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    copies, start = {}, collections.Counter()
    for doc, text, source in sorted(rows, key=lambda r: hashlib.md5(f"20:{r[0]}".encode()).hexdigest()):
        n = len(WORD.findall(text or ""))
        goal = math.floor(target[source] + 1e-9)
        copies[doc] = sum(min(n, goal - e * sizes[source] - start[source]) > 0 for e in range(2))
        start[source] += n
    return copies


def test_run(spark):
    docs = read_table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_model.train(docs, read_table(spark, SF, "labels"), "quality", queries.fold(4) != 2)
    good = [d for d, r in rows.items() if model.score([(r.text or "").encode()])[0] >= queries.QUALITY_LEAST]
    near = plain_near([(d, rows[d].text) for d in good])
    single = sorted({c for _, _, c in near})
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in plain_report([(d, rows[d].text) for d in single], items) if r[-1]}
    clean = [d for d in single if d not in dirty]
    copies = plain_copies([(d, rows[d].text, rows[d].source) for d in clean])
    t, want, start = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), [], 0
    for d in sorted(clean):
        ids = t.encode(rows[d].text or "", add_special_tokens=False).ids + [queries.END_ID]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert len(good) < len(rows) and len(single) < len(good) and dirty
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_return_documents(spark, odd):
    """Odd rows go through every stage; all but the last keep the columns."""
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns, name
            kept = out


def test_stages_on_an_empty_table(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


COLUMNS = {
    "op1_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_": ["doc_id", "size", "source_size", "target", "taken"], "op3_": ["doc_id", "fingerprint", "component_id"],
    "op4_": ["page_id", "host", "path", "rule", "verdict"], "op5_": ["doc_id", "held_out", "score", "predicted"],
    "op6_": ["doc_id", "start", "n_tokens", "ids_crc32"], "op7_": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op8_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_": ["doc_id", "held_out", "score", "predicted"]}


def test_registered(spark):
    registered = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert len(queries.QUERIES) == 13
    for prefix in COLUMNS:
        assert sum(n.startswith(prefix) for n in registered) == 1


@pytest.mark.parametrize("prefix", ["op1_", "op3_", "op4_", "op7_", "op8_", "op9_"])
def test_result_columns(spark, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[:len(COLUMNS[prefix])] == COLUMNS[prefix]
    table = "pages" if prefix in ("op4_", "op8_") else "documents"
    assert df.count() == read_table(spark, SF, table).count()
    if prefix == "op3_":
        assert df.filter(F.length("fingerprint") != 16).count() == 0


NEW_COLUMNS = {
    "op11_": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12_": ["item_id", "rank", "doc_id", "score"],
    "op13_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]}


@pytest.mark.parametrize("prefix", NEW_COLUMNS)
def test_columns_and_types_of_the_search_operators(spark, prefix):
    name, = (n for n in queries.QUERIES if n.startswith(prefix))
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[:len(NEW_COLUMNS[prefix])] == NEW_COLUMNS[prefix]
    types = dict(df.dtypes)
    assert all(types[c] == ("int" if c == "rank" else "string" if "sha256" in c or "fingerprint" in c else
                            "double" if c.startswith("near") else "bigint") for c in NEW_COLUMNS[prefix])
