"""Operator 8: benchmark decontamination by a BM25 index with block-max pruning.

The benchmark's items are the indexed documents, every passage of the training
texts is a query. A word is a run of ASCII letters and digits and non-ASCII
characters, ASCII lower-cased. Items are put in classes of length ratio 2. A class's
passages are two cells of as many words as its longest item has, starting at every
cell, so an item lies whole in some passage.

Retrieval is exact: all items whose BM25 score reaches their threshold, a lower bound of
the scores of passages that hold ``OVERLAP`` of the item's shingles: each term's impact is
spread over the shingles that hold it, and the dearest shingles that may be missing are
taken off the item's score with itself. Items are put in blocks; the index holds each term's largest
impact per block. Of each block the commonest terms, as many as together stay under
half of the block's lowest threshold, are not essential: they cannot make a match
alone. A block is scored for a passage only if the maxima of the essential terms that
the passage holds, plus all that the others could add, reach the lowest threshold. (These essential terms do what
WAND's pivots do over posting cursors, for all passages of a batch at once.)

A retrieved item is verified on 5-word shingles: its last sentence is its answer
and the rest its question (an item of one sentence is a question). The document
is contaminated if the passage holds at least ``OVERLAP`` of the item's question
and answer shingles together (a part of under 5 words is one shingle).

The index is broadcast in slices of at most ``SLICE`` postings; each slice is a pass
over the texts, so the benchmark may be of any size. Document frequencies and mean
length are those of the whole benchmark.

Cases: null or wordless texts and items match nothing; null ids are ignored; items of
the same id are taken as one text each, the better match counts; an empty table on
either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, materialise

K1, B = 1.2, 0.75
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
SLICE = 1_000_000
_ITEM_SCHEMA = ("item_id long, row long, n long, terms array<long>, tf array<long>, question array<long>, answer array<long>, "
                "of array<long>, unit array<long>")


def _words(text: str) -> textops.Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return textops.Words(raw, np.array([0, len(raw)]), textops.NOT_ALNUM)


def holders(h: np.ndarray, terms: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (term number, shingle number) pairs of a part: which of its distinct shingles hold which terms."""
    k = min(k, len(h))
    if not k:
        return (np.zeros(0, np.int64),) * 2
    n = len(h) - k + 1
    code = np.zeros(n, np.uint64)
    for j in range(k):
        code = textops.mix(code + h[j:j + n])
    units, unit = np.unique(code, return_inverse=True)
    at = np.unique(np.concatenate([np.searchsorted(terms, h[j:j + n]) * len(units) + unit for j in range(k)]))
    return at // len(units), at % len(units)


def part_shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of k words of a part; a shorter part is one run; none for an empty part."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = textops.mix(out + h[j:j + len(out)])
    return np.unique(out)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last one."""
    parts = re.findall(r"[^.!?]*[.!?]*\s*", text.strip())
    parts = [x for x in parts if x.strip()]
    return (text, "") if len(parts) < 2 else ("".join(parts[:-1]), parts[-1])


def item_rows(items: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for i, text, row in zip(*(b.column(c).to_pylist() for c in ("item_id", "text", "row")), strict=True):
                h = _words(text).hash
                terms, tf = np.unique(h, return_counts=True)
                parts = [_words(x).hash for x in split_item(text)]
                q, a = (part_shingles(x) for x in parts)
                (of, unit), (of_a, unit_a) = (holders(x, terms) for x in parts)
                out.append((i, row, len(h), terms.view(np.int64), tf, q.view(np.int64), a.view(np.int64),
                            np.concatenate([of, of_a]), np.concatenate([unit, unit_a + len(q)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate([pa.int64()] * 3 + [pa.list_(pa.int64())] * 6)],
                names=["item_id", "row", "n", "terms", "tf", "question", "answer", "of", "unit"])

    return items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn(
        "row", F.xxhash64("item_id", "text")).mapInArrow(run, _ITEM_SCHEMA).where("n > 0")


def lowest_score(row, impact: np.ndarray) -> float:
    """Least BM25 score of a passage with ``OVERLAP`` of an item's shingles: without a term, all that hold it are missing."""
    of, unit = np.array(row["of"], np.int64), np.array(row["unit"], np.int64)
    total = len(row["question"]) + len(row["answer"])
    worth = np.bincount(unit, (impact / np.maximum(1, np.bincount(of, minlength=len(impact))))[of], total)
    missing = total - int(np.ceil(OVERLAP * total - 1e-9))
    return float(impact.sum() - np.sort(worth)[total - missing:].sum())


class Index:
    """BM25 impacts of a slice of the items, by term, with block maxima and the essential terms."""

    def __init__(self, items: list, df: dict[int, int], count: int, mean: float):
        self.cell = max(r["n"] for r in items)
        self.ids = np.array([r["item_id"] for r in items])
        self.question = [np.array(r["question"], np.int64).view(np.uint64) for r in items]
        self.answer = [np.array(r["answer"], np.int64).view(np.uint64) for r in items]
        item = np.repeat(np.arange(len(items)), [len(r["terms"]) for r in items])
        term = np.concatenate([np.array(r["terms"], np.int64) for r in items]).view(np.uint64)
        tf = np.concatenate([np.array(r["tf"], float) for r in items])
        n = np.array([r["n"] for r in items], float)[item]
        of = np.array([df[t] for r in items for t in r["terms"]], float)
        impact = np.log1p((count - of + 0.5) / (of + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
        own = np.split(impact, np.cumsum([len(r["terms"]) for r in items])[:-1])
        self.threshold = np.array([lowest_score(r, x) for r, x in zip(items, own, strict=True)])
        self.terms, t = np.unique(term, return_inverse=True)
        order = np.lexsort((item, t))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(t[order], np.arange(len(self.terms) + 1))
        block = self.item // BLOCK
        new = np.append(True, (block[1:] != block[:-1]) | (t[order][1:] != t[order][:-1]))
        at = np.flatnonzero(new)
        self.block, self.block_max = block[at], np.maximum.reduceat(self.impact, at)
        blocks = int(block.max()) + 1
        self.block_low = np.minimum.reduceat(self.threshold, np.arange(blocks) * BLOCK)
        # Postings of block maxima, commonest terms first: idle while they stay under half the threshold.
        tt = t[order][at]
        often = np.array([df[x] for x in self.terms.view(np.int64).tolist()])[tt]
        by = np.lexsort((self.block_max, -often, self.block))
        run = np.cumsum(self.block_max[by])
        begin = np.flatnonzero(np.append(True, self.block[by][1:] != self.block[by][:-1]))
        before = np.repeat((run - self.block_max[by])[begin], np.diff(np.append(begin, len(by))))
        idle = np.zeros(len(by), bool)
        idle[by] = run - before < 0.5 * self.block_low[self.block[by]]
        self.idle_most = np.bincount(self.block[idle], self.block_max[idle], blocks)
        self.block, self.block_max, tt = self.block[~idle], self.block_max[~idle], tt[~idle]
        self.block_first = np.searchsorted(tt, np.arange(len(self.terms) + 1))
        self.essential = self.block_first[1:] > self.block_first[:-1]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 for none."""
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[t] == h[at]
        out[at[ok]] = t[ok]
        return out

    def candidates(self, term: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs that may hold a match, from all term hits by passage."""
        use = (term >= 0)
        use[use] = self.essential[term[use]]
        code = np.unique(passage[use] * len(self.terms) + term[use])
        p, t = code // len(self.terms), code % len(self.terms)
        per = self.block_first[t + 1] - self.block_first[t]
        at = np.repeat(self.block_first[t] - np.cumsum(per) + per, per) + np.arange(per.sum())
        blocks = len(self.block_low)
        pair, inv = np.unique(np.repeat(p, per) * blocks + self.block[at], return_inverse=True)
        most = np.bincount(inv, self.block_max[at], len(pair))
        block = pair % blocks
        ok = most + self.idle_most[block] >= self.block_low[block] * 0.999
        return pair[ok] // blocks, block[ok]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Score of every item for the distinct terms of a passage."""
        per = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(per) + per, per) + np.arange(per.sum())
        return np.bincount(self.item[at], self.impact[at], len(self.ids))


def search_batch(indexes: list[Index], b: pa.RecordBatch) -> list[tuple]:
    w = textops.Words(*textops.text_buffers(b.column("text")), textops.NOT_ALNUM)
    return [x for index in indexes for x in search_words(index, w)]


def search_words(index: Index, w: textops.Words) -> list[tuple]:
    """(text, item id, passage start and end, score, question and answer overlap) of a batch's verified matches."""
    term = index.find(w.hash)
    hit = np.flatnonzero(term >= 0)
    if not len(hit):
        return []
    text = np.searchsorted(w.off, hit, "right") - 1
    cells = -(-np.diff(w.off) // index.cell)
    base = np.concatenate([[0], np.cumsum(cells)])
    cell = base[text] + (hit - w.off[text]) // index.cell
    # A hit belongs to the passage that starts at its cell and to the one before, within its text.
    back = cell > base[text]
    passage = np.concatenate([cell, cell[back] - 1])
    terms = np.concatenate([term[hit], term[hit][back]])
    found, block = index.candidates(terms, passage)
    out = []
    if not len(found):
        return []
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    for x0, x1 in zip(first.tolist(), [*first[1:].tolist(), len(found)], strict=True):
        p, blocks = int(found[x0]), block[x0:x1]
        i = int(np.searchsorted(base, p, "right")) - 1
        lo = w.off[i] + (p - base[i]) * index.cell
        hi = min(lo + 2 * index.cell, w.off[i + 1])
        t = np.unique(term[lo:hi])
        score = index.scores(t[t >= 0])
        good = np.flatnonzero(score >= index.threshold * 0.999)
        good = good[np.isin(good // BLOCK, blocks)]
        if not len(good):
            continue
        held: dict[int, np.ndarray] = {}
        for x in good.tolist():
            q, a = index.question[x], index.answer[x]
            shared = []
            for part in (q, a):
                size = SHINGLE if len(part) != 1 else None
                if size is None:
                    sizes = range(1, SHINGLE + 1)
                    shared.append(int(any(np.isin(part, held.setdefault(k, runs(w.hash[lo:hi], k))).all() for k in sizes)))
                else:
                    shared.append(int(np.isin(part, held.setdefault(size, runs(w.hash[lo:hi], size))).sum()))
            if sum(shared) >= OVERLAP * (len(q) + len(a)):
                out.append((i, int(index.ids[x]), int(lo - w.off[i]), int(hi - w.off[i]), float(score[x]),
                            shared[0] / len(q) if len(q) else 1.0, shared[1] / len(a) if len(a) else 1.0))
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    return part_shingles(h, k) if len(h) >= k else np.zeros(0, np.uint64)


_HIT_SCHEMA = ("doc_id long, item_id long, start_word long, end_word long, score double, question_overlap double, "
               "answer_overlap double")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per contaminated document and item, with the best passage (most score, then the first)."""
    rows = materialise(item_rows(items), "bench-items")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    spark = docs.sparkSession
    if not stats["n"]:
        return spark.createDataFrame([], _HIT_SCHEMA)
    df = materialise(rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")), "bench-df")
    sized = rows.select("row", (F.size("terms") + F.size("question") + F.size("answer") + F.size("of")).alias("w"))
    slices = max(1, -(-int(sized.agg(F.sum("w")).first()[0]) // SLICE))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(slices):
        some = rows.where(F.pmod(F.col("row"), F.lit(slices)) == k)
        known = some.select(F.explode("terms").alias("t")).distinct().join(df, "t")
        chosen = sorted(some.collect(), key=lambda r: (r["n"], r["item_id"], r["row"]))   # SLICE values at most
        if not chosen:
            continue
        of = {r["t"]: r["df"] for r in known.collect()}
        classes: dict[int, list] = {}
        for r in chosen:
            classes.setdefault((r["n"] - 1).bit_length(), []).append(r)
        indexes = [Index(c, of, stats["n"], stats["mean"]) for c in classes.values()]
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches, shared=shared):
            for whole in batches:
                for b in textops.pieces(whole):
                    found = search_batch(shared.value, b)
                    ids = b.column("doc_id").to_pylist()
                    cols = list(zip(*found, strict=True)) if found else [[]] * 7
                    cols[0] = [ids[i] for i in cols[0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if j < 4 else pa.float64()) for j, c in enumerate(cols)],
                        names=[x.split()[0] for x in _HIT_SCHEMA.split(", ")])

        hits = docs.mapInArrow(run, _HIT_SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    names = ["start_word", "end_word", "score", "question_overlap", "answer_overlap"]
    best = F.max(F.struct("score", (-F.col("start_word")).alias("at"), *names[:2], *names[3:])).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col(f"m.{c}") for c in names])


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = materialise(contaminated(docs, items).select("doc_id").distinct(), "bench-hits")
    return docs.join(bounded(bad), "doc_id", "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
