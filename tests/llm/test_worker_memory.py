"""What a Python worker holds: bounded while a task runs, given back when it ends."""

import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from ticketscope.llm import common, token_store
from ticketscope.llm.queries import END_ID, TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
TEXT = "some words that come again and again, in a long text " * 120


def own_mb():
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_encoding_works_in_small_slices():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": [TEXT] * 4000})  # 25 MB
    whole = token_store.encoder(PATH).encode(TEXT.encode()) + np.array([END_ID], token_store.encoder(PATH).dtype).tobytes()
    tracemalloc.start()
    try:
        rows = 0
        for out in token_store._encode_batches(iter([batch]), PATH, END_ID):
            assert out.column(1)[0].as_py() == whole and out.column(1)[out.num_rows - 1].as_py() == whole
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4000
    assert peak < 60e6


def test_counting_works_in_small_slices():
    ids = np.arange(3000, dtype="<u2").tobytes()
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([ids] * 5000, pa.binary())})  # 30 MB
    tracemalloc.start()
    try:
        out, = token_store._count_batches(iter([batch]), "<u2")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.column(0).to_pylist() == list(range(3000)) and set(out.column(1).to_pylist()) == {5000}
    assert peak < 60e6


def test_freed_memory_goes_back_when_a_task_ends():
    kept = []

    def work(batches):
        for b in batches:
            parts = [np.ones(12_000) for _ in range(2000)]  # 192 MB in pieces that the allocator keeps
            kept.append(parts[-1])
            yield b

    before = own_mb()
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.hands_back(work)(iter([batch]))) == [batch]
    assert own_mb() - before < 100


def test_every_worker_function_of_the_pipeline_hands_back():
    from ticketscope.llm import decontaminate, quality_model, simhash
    for module in (decontaminate, quality_model, simhash, token_store):
        for name, f in vars(module).items():
            if name.endswith("_batches"):
                assert hasattr(f, "__wrapped__"), name
