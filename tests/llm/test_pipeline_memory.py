"""What the pipeline's Python workers hold at once: small batches, and little beside them."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from premia.llm import suffix_dedup
from premia.llm.common import ARROW_BYTES


class _Caught:
    """Stands for a frame; gives back the function that would run over its batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, fn, schema):
        return fn


def _peak_mb(fn, batch: pa.RecordBatch) -> float:
    for _ in fn(iter([batch.slice(0, 1)])):      # tables that stay, like powers
        pass
    tracemalloc.start()
    try:
        for _ in fn(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_suffix_starts_hold_little_beside_a_batch():
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(2_000))
    batch = pa.record_batch({"doc_id": pa.array(range(300)), "text": pa.array([text] * 300)})
    assert batch.nbytes > 3 << 20
    assert _peak_mb(suffix_dedup.suffix_starts(_Caught(), 50), batch) < 30


def test_stages_whose_result_comes_from_python_are_written_in_small_batches(spark):
    old = spark.conf.get(ARROW_BYTES)
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(60 + k)), "en", "s", 9) for k in range(4)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.cut_repeated_passages, corpus_pipeline.pack):
            spark.conf.set(ARROW_BYTES, "64m")
            out = stage(spark, docs, "")
            assert spark.conf.get(ARROW_BYTES) == "2m"
            assert out.columns
    finally:
        spark.conf.set(ARROW_BYTES, old)


def test_suffixes_that_end_early_or_hold_the_word_hash_zero():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 1 << 32, 90, dtype=np.uint64).astype(np.uint32)
    word[[20, 60, 61]] = 0                      # a hash that looks like the filling past a suffix's end
    other = np.concatenate([rng.integers(0, 1 << 32, 7, dtype=np.uint64).astype(np.uint32), word[10:75],
                            rng.integers(0, 1 << 32, 9, dtype=np.uint64).astype(np.uint32)])
    rows = []
    for doc, w in ((1, word), (2, other)):
        at = np.flatnonzero(w == word[40])[0]   # one start, chosen by every window around it
        first, last = max(0, at - 30), min(len(w) - 50, at)
        rows.append((5, doc, int(at), int(first), int(last), w[first:last + 50].tobytes()))
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("h", "doc_id", "pos", "first", "last", "words"))})
    assert suffix_dedup.compare_suffixes(table, 50).to_pylist() == [{"doc_id": 2, "start": 7, "end": 72}]
