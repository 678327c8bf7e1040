"""Operator 12: phrase collocations from mergeable Misra-Gries summaries.

Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and 0x0A-0x0D, pieces into
words at space and tab. A phrase is 1 to 4 consecutive words of a piece; everything is per
language.

1. Tasks count the hashes of their phrases and send them to hash partitions, a few
   kilobytes to a row. Each partition merges them in a Misra-Gries summary whose capacity
   exceeds its mass (announced first) divided by the threshold (``ROOM`` times), so that all
   decrements together stay below the threshold and no frequent phrase is lost; counters that
   stay below the threshold even with all decrements added back are dropped. Phrases of one
   and two words go first; of longer ones only those whose word pairs all survived.
2. Survivors become a sieve of at most ``SIEVE_BITS`` bits (a fuller sieve passes more, never
   less). A second pass counts exactly, by language and words, the phrases that it passes; tasks
   send them to the same hash partitions, packed, and each partition adds them up.
3. Candidates are joined with the counts of their parts and of longer candidates.

Cases: null or empty texts have no words; null language is ``und``; a repeated row is a
text of its own; equal scores rank by count, then phrase; no documents or no frequent
phrase give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import materialise, table

THRESHOLD = 30
LONGEST = 4
ROOM = 4                   # capacity of a summary, as a multiple of mass / threshold
TOP = 2000
SIEVE_BITS = 1 << 28       # at most 32 MB
PART_CHARS = 16 << 20      # of text for each hash partition
CHUNK = 2 << 20            # phrases counted together in a task
ROW = 16_384               # counters in a row
HELD = 400_000             # phrases that a task counts before it sends them on
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEPARATORS = _CUT.copy()
_SEPARATORS[[0x20, 0x09]] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


class Phrases:
    """Words of a batch and the hashes of the phrases that start at each; ``left``: words to the piece's end."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, off = textops.text_buffers(batch.column("text"))
        w = self.words = textops.Words(self.data, off, _SEPARATORS)
        self.langs = batch.column("lang").to_pylist()
        n = len(w.start)
        piece = np.cumsum(_CUT[self.data], dtype=np.int32)[w.start] if n else np.zeros(0, np.int32)
        edges = np.unique(np.concatenate([np.flatnonzero(piece[1:] != piece[:-1]) + 1, w.off]))
        self.left = edges[np.searchsorted(edges, np.arange(n), "right")] - np.arange(n) if n else np.zeros(0, np.int64)
        salts = {x: _salt(x) for x in set(self.langs)}
        self.doc = np.repeat(np.arange(len(self.langs)), np.diff(w.off))
        own = np.array([salts[x] for x in self.langs], np.uint64)[self.doc] if n else np.zeros(0, np.uint64)
        self.hashes = [textops.mix(w.hash + own)]
        for size in range(2, LONGEST + 1):
            longer = np.zeros(n, np.uint64)
            if n >= size:
                longer[:n - size + 1] = textops.mix(self.hashes[-1][:n - size + 1] * _ODD + self.hashes[0][size - 1:])
            self.hashes.append(longer)

    def at(self, size: int) -> np.ndarray:
        """Positions where a phrase of ``size`` words starts."""
        return np.flatnonzero(self.left >= size)

    def phrase(self, i: int, size: int) -> str:
        w, raw = self.words, self.data
        return b" ".join(raw[w.start[j]:w.end[j]].tobytes() for j in range(i, i + size)).lower().decode()


def passes(sieve: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - bits)
    return (sieve[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summaries(batches, sizes, parts: int, sieve):
    """Rows ``(p, kind, h, c)``: kind 1 counts of phrase hashes, kind 0 the mass sent to a partition."""
    mass = np.zeros(1 << parts, np.int64)
    waiting, held = [], 0

    def rows():
        h, c = np.unique(np.concatenate(waiting), return_counts=True)
        p = (h >> np.uint64(64 - parts)).astype(np.int64) if parts else np.zeros(len(h), np.int64)
        low = ((h << np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)
        np.add.at(mass, p, c)
        edges = np.flatnonzero(np.append(True, p[1:] != p[:-1])).tolist()
        cuts = [(i, min(i + ROW, b)) for a, b in zip(edges, [*edges[1:], len(p)], strict=True) for i in range(a, b, ROW)]
        c = c.astype(np.uint32)
        for k in range(0, len(cuts), 256):
            part = cuts[k:k + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p[i]) for i, _ in part], pa.int64()), pa.array([1] * len(part), pa.int32()),
                 pa.array([low[i:j].tobytes() for i, j in part], pa.binary()),
                 pa.array([c[i:j].tobytes() for i, j in part], pa.binary())], names=["p", "kind", "h", "c"])

    for whole in batches:
        for b in textops.pieces(whole):
            ph = Phrases(b)
            for size in sizes:
                at = ph.at(size)
                if sieve is not None:
                    pairs = passes(sieve.value[0], sieve.value[1], ph.hashes[1])
                    for j in range(size - 1):
                        at = at[pairs[at + j]]
                waiting.append(ph.hashes[size - 1][at])
                held += len(at)
            if held >= CHUNK:
                yield from rows()
                waiting, held = [], 0
    if held:
        yield from rows()
    some = np.flatnonzero(mass)
    none = pa.array([None] * len(some), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array(np.zeros(len(some), np.int32)),
         pa.array([int(x).to_bytes(8, "little") for x in mass[some]], pa.binary()), none], names=["p", "kind", "h", "c"])


class MisraGries:
    """Summary of one hash partition; merging summaries and cutting to ``capacity`` keeps the guarantee."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.lost = capacity, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > self.capacity + CHUNK // 4:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        over = len(self.keys) - self.capacity
        if over > 0:      # the largest counter that has to go is taken off all
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.counts, self.lost = self.counts - cut, self.lost + cut
            keep = self.counts > 0
            self.keys, self.counts = self.keys[keep], self.counts[keep]
        self.waiting, self.held = [], 0

    def at_least(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times: a count is at most its counter and all decrements."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def _survivors(batches, parts: int, bits: int, threshold: int):
    """One row per partition: its region of the sieve."""
    def region(p, summary):
        size = bits - parts
        mask = np.zeros(1 << size, np.uint8)
        mask[summary.at_least(threshold) >> np.uint32(32 - size)] = 1
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()),
                                           pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())],
                                          names=["p", "region"])

    p, mass, summary = None, 0, None
    for b in batches:
        for q, kind, h, c in zip(*(b.column(x).to_pylist() for x in ("p", "kind", "h", "c")), strict=True):
            if q != p:
                if summary is not None:
                    yield region(p, summary)
                p, mass, summary = q, 0, None
            if kind == 0:
                mass += int.from_bytes(h, "little")
                continue
            if summary is None:
                summary = MisraGries(ROOM * mass // threshold + 1)
            summary.merge(np.frombuffer(h, np.uint32), np.frombuffer(c, np.uint32))
    if summary is not None:
        yield region(p, summary)


def partition_bits(chars: int, part_chars: int) -> int:
    """Bits of a hash that name its partition: a partition for every ``part_chars`` characters of text."""
    return max(0, math.ceil(math.log2(max(1, chars / part_chars))))


def frequent_sieve(docs: DataFrame, sizes: list[int], chars: int, threshold: int, sieve=None, part_chars: int = PART_CHARS):
    """Broadcast ``(bytes, bits)`` that passes every phrase of ``sizes`` with ``threshold`` occurrences in a language."""
    sc = docs.sparkSession.sparkContext
    parts = partition_bits(chars, part_chars)
    # Eight slots a counter; every partition has a region of at least a byte.
    bits = max(parts + 3, min(int(math.log2(SIEVE_BITS)), math.ceil(math.log2(8 * (1024 + chars / threshold)))))
    bits = min(bits, parts + 32)
    sent = docs.mapInArrow(lambda b: _summaries(b, sizes, parts, sieve), "p long, kind int, h binary, c binary")
    regions = sent.repartition("p").sortWithinPartitions("p", "kind").mapInArrow(
        lambda b: _survivors(b, parts, bits, threshold), "p long, region binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - 3 - parts)
    for p, region in regions.collect():
        whole[p * size:(p + 1) * size] = np.frombuffer(region, np.uint8)
    return sc.broadcast((whole, bits))


_ENTRY = "lang string, phrase string, size int, count long"
_PACKED = [("p", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary()), ("words", pa.int64())]


def _counts(batches, short, long, parts: int):
    """Rows of a hash partition and language: its phrases that pass the sieves, sorted and compressed, with their counts
    so far (a line end is in no word); rows without phrases hold each language's words."""
    place: dict[int, int] = {}
    keys, langs, phrases, sizes, counts = [], [], [], [], []

    def rows():
        h = np.array(keys, np.uint64)
        p = (h >> np.uint64(64 - parts)).astype(np.int64) if parts else np.zeros(len(h), np.int64)
        groups: dict = {}
        for i, q in enumerate(p.tolist()):
            groups.setdefault((q, langs[i]) if phrases[i] is not None else (0, langs[i], None), []).append(i)
        out = []
        for key, at in groups.items():
            if len(key) == 3:                # a language's words
                out.append((0, key[1], None, None, counts[at[0]]))
                continue
            at.sort(key=phrases.__getitem__)
            text = zlib.compress("\n".join([phrases[i] for i in at]).encode(), 1)
            out.append((*key, text, zlib.compress(np.array([counts[i] for i in at], np.int64).tobytes(), 1), None))
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[i:i + 256]], t) for k, (_, t) in enumerate(_PACKED)],
                                             names=[n for n, _ in _PACKED])

    for whole in batches:
        for b in textops.pieces(whole):
            ph = Phrases(b)
            for lang, n in zip(ph.langs, np.diff(ph.words.off).tolist(), strict=True):
                at = place.setdefault(lang, len(keys))
                if at == len(keys):
                    for x, v in ((keys, 0), (langs, lang), (phrases, None), (sizes, 0), (counts, 0)):
                        x.append(v)
                counts[at] += n
            pairs = None
            for size in range(1, LONGEST + 1):
                at = ph.at(size)
                if size > 2:
                    for j in range(size - 1):
                        at = at[pairs[at + j]]
                h = ph.hashes[size - 1]
                sieve, bits = (short if size <= 2 else long).value
                if size == 2:
                    pairs = passes(sieve, bits, h)
                    at = at[pairs[at]]
                else:
                    at = at[passes(sieve, bits, h[at])]
                found, first, many = np.unique(h[at], return_index=True, return_counts=True)
                for key, i, c in zip(found.tolist(), at[first].tolist(), many.tolist(), strict=True):
                    known = place.get(key)
                    if known is not None:
                        counts[known] += c
                    else:
                        place[key] = len(keys)
                        keys.append(key)
                        langs.append(ph.langs[ph.doc[i]])
                        phrases.append(ph.phrase(i, size))
                        sizes.append(size)
                        counts.append(c)
            if len(keys) > HELD:
                yield from rows()
                place = {}
                keys, langs, phrases, sizes, counts = [], [], [], [], []
    if keys:
        yield from rows()


def _totals(batches, threshold: int):
    """Exact sums of a partition's entries, by language and words."""
    p, held, size = None, [], 0

    def settle():
        whole = pa.concat_tables(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("count", "sum")])
        return whole.select(["lang", "phrase", "size", "count_sum"]).rename_columns(["lang", "phrase", "size", "count"])

    def out():
        whole = settle()
        keep = pc.or_(pc.is_null(whole["phrase"]), pc.greater_equal(whole["count"], threshold))
        return whole.filter(keep).combine_chunks().to_batches()

    for b in batches:
        for q, lang, text, counts, words in zip(*(b.column(n).to_pylist() for n, _ in _PACKED), strict=True):
            if q != p:
                if held:
                    yield from out()
                p, held, size = q, [], 0
            if text is None:
                phrases, counts = [None], np.array([words], np.int64)
            else:
                phrases, counts = zlib.decompress(text).decode().split("\n"), np.frombuffer(zlib.decompress(counts), np.int64)
            own = pa.array(phrases, pa.string())
            spaces = pc.fill_null(pc.count_substring(own, " "), -1)
            held.append(pa.table([pa.array([lang] * len(own), pa.string()), own, pc.add(spaces, 1).cast(pa.int32()),
                                  pa.array(counts)], names=["lang", "phrase", "size", "count"]))
            size += len(own)
            if size > 1_000_000 and len(held) > 1:
                held, size = [settle()], 0
    if held:
        yield from out()


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, part_chars: int = PART_CHARS) -> DataFrame:
    """``(lang, phrase, size, a)`` of all phrases with at least ``threshold`` occurrences, and null phrase: all words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = partition_bits(chars, part_chars)
    short = frequent_sieve(docs, [1, 2], chars, threshold, part_chars=part_chars)
    long = frequent_sieve(docs, list(range(3, LONGEST + 1)), chars, threshold, short, part_chars)
    sent = docs.mapInArrow(lambda b: _counts(b, short, long, parts), "p long, lang string, phrases binary, counts binary, words long")
    # Phrases that only passed the sieve fall out here.
    return sent.repartition("p").sortWithinPartitions("p").mapInArrow(
        lambda b: _totals(b, threshold), _ENTRY).withColumnRenamed("count", "a")


def collocations(docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD, part_chars: int = PART_CHARS) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score."""
    counted = materialise(phrase_counts(docs, threshold, part_chars), "phrase-counts")
    known = counted.where("phrase is not null").select("lang", "phrase", "a", "size")
    words = counted.where("phrase is null").select("lang", F.col("a").alias("n"))
    candidates = known.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("x"),
        F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("y"))
    part = known.select("lang", "phrase", "a")
    scored = cuts.join(part.select("lang", F.col("phrase").alias("x"), F.col("a").alias("l")), ["lang", "x"]).join(
        part.select("lang", F.col("phrase").alias("y"), F.col("a").alias("r")), ["lang", "y"])
    score = F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div "
                   "(cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").cast("long")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = candidates.where("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn(
        "i", F.explode(F.expr("sequence(1, size - m + 1)"))).select(
        "lang", F.array_join(F.expr("slice(w, i, m)"), " ").alias("phrase"), F.col("a").alias("longer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = lowest.join(covered, ["lang", "phrase"], "left").where(
        "longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * 80")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                             "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


# Exact: all phrases of one to four words listed and counted.
ORACLE_SQL = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS id, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(words) > 0),
g AS (
  SELECT lang, m AS size, array_to_string(words[i + 1 : i + m], ' ') AS phrase FROM (
    SELECT lang, words, m, unnest(range(0, len(words) - m + 1)) AS i
    FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m)),
n AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.a, k, fx.a AS l, fy.a AS r, (2000000::HUGEINT * k.a) // (fx.a + fy.a) AS score
  FROM k JOIN f fx ON fx.lang = k.lang AND fx.phrase = x JOIN f fy ON fy.lang = k.lang AND fy.phrase = y),
low AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
sub AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
alone AS (
  SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
