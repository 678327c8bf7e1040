"""Operator 2: repeated passages by sparse suffix arrays.

A passage of at least ``min_words`` words (compared as lower-cased words) that
occurred earlier, in a document of smaller id or earlier in the same one, is a
repeat; its first occurrence stays. The result is the union of all repeated
windows of ``min_words`` words, exact up to word-hash collisions.

1. Suffixes are kept only at content-selected positions: in each window of
   ``min_words`` words, the leftmost position whose ``GRAM``-word hash is smallest.
   Equal windows choose the same position, so a repeated window shares a suffix
   start with its earlier occurrence.
2. Suffixes whose first GRAM words occur once are dropped. The others get the
   words around them, as far as the windows that chose them reach.
3. Suffixes are sorted by their words. For each left extension by o words,
   neighbours in that order with equal left words and ``min_words`` - o equal words
   on the right hold the same window; all but the first occurrence are marked.
4. Marked windows of a document are joined into maximal spans.

Documents with the same text as an earlier one are repeats as a whole and not
sorted. A start shared by more than ``HOT`` suffixes is not sorted in one task: its
windows are hashed and grouped with partial aggregation, with the same result.

Cases: null or empty texts, texts under ``min_words`` words and rows with a null id
have no repeats; a row that repeats another's id and text is the same document;
no documents give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, discard, map_groups, materialise

MIN_WORDS = 50
GRAM = 20
HOT = 50_000
_START_SCHEMA = "h long, doc_id long, pos long, first long, last long"
_CONTEXT_SCHEMA = "h long, doc_id long, pos long, first long, last long, words binary"


def minimisers(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen positions of ``g`` (leftmost smallest of each ``span``), with the first and last window that chose each."""
    n = len(g) - span + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    v, at, size = g, np.arange(len(g)), 1
    while size * 2 <= span:
        left = v[:-size] <= v[size:]
        v, at, size = np.where(left, v[:-size], v[size:]), np.where(left, at[:-size], at[size:]), size * 2
    far = span - size
    left = v[:n] <= v[far:far + n]
    at = np.where(left, at[:n], at[far:far + n])
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], first, np.append(first[1:], n) - 1


def suffix_starts(docs: DataFrame, min_words: int) -> DataFrame:
    """Content-selected suffix starts of each document with the windows that chose them."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                w = textops.Words(*textops.text_buffers(b.column("text")))
                grams, _ = w.shingles(GRAM)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                out = []
                for i in range(b.num_rows):
                    lo, hi = w.off[i], w.off[i + 1]
                    if hi - lo >= min_words:
                        g = grams[lo:hi - GRAM + 1]
                        at, first, last = minimisers(g, min_words - GRAM + 1)
                        out.append((g[at].view(np.int64), np.full(len(at), ids[i]), at, first, last))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(5)],
                                                     names=["h", "doc_id", "pos", "first", "last"])

    return docs.select("doc_id", "text").mapInArrow(run, _START_SCHEMA)


def contexts(docs: DataFrame, min_words: int) -> DataFrame:
    """Each start with the 32-bit word hashes from its first window's first word to its last window's last."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                w = textops.Words(*textops.text_buffers(b.column("text")))
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                lists = b.column("starts")
                flat = lists.flatten()
                per = np.diff(lists.offsets.to_numpy())
                pos, first, last, h = (flat.field(k).to_numpy() for k in range(4))
                base = np.repeat(w.off[:-1], per)
                lo, hi = (base + first).tolist(), (base + last + min_words).tolist()
                words = [short[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
                ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), per)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h, ids, pos, first, last)] + [pa.array(words, pa.binary())],
                    names=["h", "doc_id", "pos", "first", "last", "words"])

    return docs.mapInArrow(run, _CONTEXT_SCHEMA)


def compare_suffixes(rows: pa.Table, min_words: int) -> pa.Table:
    """Repeated spans ``(doc_id, start, end)`` among suffixes of one or more whole groups."""
    h, doc, pos, first, last = (rows[c].to_numpy() for c in ("h", "doc_id", "pos", "first", "last"))
    order = np.lexsort((pos, doc, h))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1])
    order = order[np.append(True, ~same)]     # a repeated row is the same document
    h, doc, pos, first, last = h[order], doc[order], pos[order], first[order], last[order]
    words = rows["words"].take(pa.array(order)).combine_chunks()
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint32)
    size = last - first + min_words
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    start = begin + pos - first                # of the suffix, in flat
    right_len, left_len = size - (pos - first), pos - first
    m = len(h)

    def word(at, ok):
        return np.where(ok, flat[np.minimum(np.maximum(at, 0), len(flat) - 1)], np.uint32(0))

    # Words past a suffix's end are 0: no comparison below reaches them.
    right = np.empty((m, min_words), np.uint32)
    for j in range(min_words):
        right[:, j] = word(start + j, j < right_len)
    suffix = np.lexsort([*right.T[::-1], h])   # the suffix array of these groups
    rank = np.empty(m, np.int64)
    rank[suffix] = np.arange(m)
    spread = min_words - GRAM
    marked = np.zeros((m, spread + 1), bool)
    left = np.zeros(m, np.uint64)
    for o in range(spread + 1):
        if o:
            left = textops.mix(left + word(start - o, o <= left_len) + np.uint64(1))
        x = np.flatnonzero((o <= left_len) & (min_words - o <= right_len))
        x = x[np.lexsort((rank[x], left[x], h[x]))]
        if len(x) < 2:
            continue
        a, b = x[:-1], x[1:]
        near = np.flatnonzero((h[a] == h[b]) & (left[a] == left[b]))
        equal = np.zeros(len(a), bool)
        equal[near] = (right[a[near], :min_words - o] == right[b[near], :min_words - o]).all(axis=1)
        run = np.concatenate([[0], np.cumsum(~equal)])
        # Rows are in (h, doc, pos) order, so the first occurrence of a run is its smallest row.
        low = np.minimum.reduceat(x, np.flatnonzero(np.append(True, ~equal)))
        marked[x[x != low[run]], o] = True
    pad = np.zeros((m, spread + 3), np.int8)
    pad[:, 1:-1] = marked
    step = np.diff(pad, axis=1)
    r0, o0 = np.nonzero(step == 1)
    r1, o1 = np.nonzero(step == -1)
    return pa.table({"doc_id": pa.array(doc[r0]), "start": pa.array(pos[r0] - (o1 - 1)),
                     "end": pa.array(pos[r0] - o0 + min_words)})


def hot_windows(batches, min_words: int):
    """Hash of every window that chose a hot start, with its document and first word."""
    for b in batches:
        doc, first, last = (b.column(c).to_numpy() for c in ("doc_id", "first", "last"))
        hashes = []
        for x in b.column("words").to_pylist():
            c = textops.mix(np.frombuffer(x, np.uint32).astype(np.uint64) + np.uint64(1))
            n = len(c) - min_words + 1
            acc = np.zeros(n, np.uint64)
            for j in range(min_words):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + c[j:j + n]
            hashes.append(textops.mix(acc).view(np.int64))
        per = last - first + 1
        if len(doc):
            at = np.concatenate([np.arange(i, j + 1) for i, j in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.repeat(doc, per)),
                                              pa.array(at)], names=["w", "doc_id", "start"])


def _merge(batches):
    """Overlapping and touching spans of each document, joined."""
    for b in batches:
        doc, start, end = [], [], []
        for d, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True):
            for s in spans:
                if doc and doc[-1] == d and s["start"] <= end[-1]:
                    end[-1] = max(end[-1], s["end"])
                else:
                    doc.append(d)
                    start.append(s["start"])
                    end.append(s["end"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, end)],
                                         names=["doc_id", "start_word", "end_word"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start_word, end_word)``: maximal unions of repeated windows, end exclusive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id is not null and text is not null")
    digest = [F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(1)).alias("d2"), F.length("text").alias("d3")]
    coded = materialise(docs.select("doc_id", *digest), "suffix-digests")
    firsts = coded.groupBy("d1", "d2", "d3").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("far")).where(
        "rep < far").drop("far")
    copies = materialise(coded.join(firsts, ["d1", "d2", "d3"]).where("doc_id > rep").select("doc_id").distinct(),
                         "suffix-copies")
    copies = bounded(copies)
    starts = materialise(suffix_starts(docs.join(copies, "doc_id", "left_anti"), min_words), "suffix-starts")
    shared = materialise(starts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "suffix-shared")
    kept = materialise(starts.join(bounded(shared), "h"), "suffix-kept")
    discard(starts)
    per_doc = kept.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("pos", "first", "last", "h")).alias("starts"))
    wanted = bounded(materialise(kept.select("doc_id").distinct(), "suffix-docs"))
    texts = docs.join(wanted, "doc_id", "left_semi")
    around = materialise(contexts(texts.join(per_doc, "doc_id").select("doc_id", "text", "starts"), min_words),
                         "suffix-contexts")
    discard(kept)
    hot = F.broadcast(shared.where(F.col("c") > HOT).select("h")) if shared.where(F.col("c") > HOT).count() <= 100_000 \
        else shared.where(F.col("c") > HOT).select("h")
    spans = map_groups(around.join(hot, "h", "left_anti"), ["h"], lambda g: compare_suffixes(g, min_words),
                       "doc_id long, start long, end long", together=True)
    windows = around.join(hot, "h", "left_semi").mapInArrow(
        lambda b: hot_windows(b, min_words), "w long, doc_id long, start long").distinct()
    low = windows.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("low"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("w", "low")
    late = windows.join(low, "w").where(F.struct("doc_id", "start") > F.col("low")).select(
        "doc_id", "start", (F.col("start") + min_words).alias("end"))
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    whole = docs.join(copies, "doc_id", "left_semi").select("doc_id", F.lit(0).cast("long").alias("start"), n.alias("end"))
    every = spans.unionByName(late).unionByName(whole.where(F.col("end") >= min_words))
    listed = every.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return listed.mapInArrow(_merge, "doc_id long, start_word long, end_word long")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a document with no word left goes.

    What is cut runs from a span's first word to the next kept word; ``n_chars`` is
    updated where it exists. Documents without repeats stay as they are.
    """
    spans = materialise(repeated_spans(docs, min_words), "suffix-spans").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    names = docs.columns

    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                at, texts = b.schema.get_field_index("text"), []
                for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    raw = text.encode()
                    w = textops.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    keep, begin = [], 0
                    for s in spans:
                        keep.append(raw[begin:w.start[s["start_word"]]])
                        begin = w.start[s["end_word"]] if s["end_word"] < len(w.start) else len(raw)
                    texts.append(b"".join([*keep, raw[begin:]]).decode())
                yield b.set_column(at, "text", pa.array(texts, pa.string())).select(names)

    ids = bounded(materialise(spans.select("doc_id"), "suffix-cut"))
    cut = docs.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select(*names, "spans").mapInArrow(run, docs.schema)
    cut = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.join(ids, "doc_id", "left_anti").select(*names).unionByName(cut.select(*names))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Exact: all 50-word windows; later occurrences marked; their words joined into spans.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, p, md5(array_to_string(words[p + 1 : p + 50], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS p FROM w WHERE len(words) >= 50)),
late AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM g) WHERE r > 1),
runs AS (
  SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + 50 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM late))
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word FROM runs GROUP BY doc_id, run
"""
