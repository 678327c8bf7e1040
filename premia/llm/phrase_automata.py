"""Operator 11: repeated passages removed by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document, words unchanged. A word goes if it
lies in a window whose words also start earlier (smaller doc_id, or same doc_id and smaller
start). The first occurrence stays; windows are judged on the input.

1. Each window chooses the leftmost smallest hash of its ``GRAM``-word grams. Equal windows
   choose the same gram, so only stretches (all windows that chose one position, at most
   ``2 * WINDOW - GRAM`` words) around a gram that occurs twice can recur.
2. Equal stretches are counted by partial aggregation and kept once, at their first place.
   Their windows are counted likewise; one that occurs twice is a confirmed recurring
   passage, located at its first occurrence.
3. Stretches are dealt to shards by their gram. A shard compiles its confirmed passages
   into Aho-Corasick automata of at most ``PATTERNS`` passages and streams its stretches
   through them; the matches say which windows of which documents have an earlier occurrence.
   A gram with more than ``HOT`` different stretches is dealt by window instead, and a window
   with more than ``HOT`` of them in several parts, each with that one passage.
4. Matches go back to the documents by id and text, where the words are cut.

A document whose whole text occurred under a smaller id needs no automaton: all its windows
occurred earlier. Exact up to collisions of 64-bit hashes of grams and stretches.

Cases: a null text has no words; texts under ``WINDOW`` words lose nothing, nor do rows
with a null id, which are no earlier occurrence either; rows with one id and one text give
equal results each; of rows with one id and different texts the smaller start is the
earlier one; no documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, discard, map_groups, materialise, table
from premia.llm.suffix_dedup import minimisers

WINDOW = 20
GRAM = 8
HOT = 4096            # stretches of one gram, or of one window, in a shard
PATTERNS = 20_000     # passages in an automaton
_START = "h long, s long, doc_id long, t long, pos long, first long, last long"
_STRETCH = "h long, s long, n long, doc_id long, t long, first long, words binary, wins array<long>"
_MATCH = "h long, s long, doc_id long, t long, first long, n long, late long, matched long"


def _prefix(w: textops.Words):
    """Function giving a hash of the words from i up to j, for arrays i and j."""
    n = len(w.hash)
    pw, inv = textops._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(textops.mix(w.hash) * pw[:n], out=sums[1:])
    return lambda i, j: textops.mix((sums[j] - sums[i]) * inv[i] + (j - i).astype(np.uint64))


def _words(batch: pa.RecordBatch) -> textops.Words:
    return textops.Words(*textops.text_buffers(batch.column("text")), fold=False)


def starts(docs: DataFrame) -> DataFrame:
    """Chosen positions of each document: gram hash, hash of the stretch, and the windows that chose it."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                w = _words(b)
                grams, _ = w.shingles(GRAM)
                span, out = _prefix(w), []
                ids, texts = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
                for i in range(b.num_rows):
                    lo, hi = w.off[i], w.off[i + 1]
                    if hi - lo >= WINDOW:
                        at, first, last = minimisers(grams[lo:hi - GRAM + 1], WINDOW - GRAM + 1)
                        s = textops.mix(span(lo + first, lo + last + WINDOW) + (at - first).astype(np.uint64))
                        out.append((grams[lo + at].view(np.int64), s.view(np.int64), np.full(len(at), ids[i]),
                                    np.full(len(at), texts[i]), at, first, last))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(7)],
                                                     names=["h", "s", "doc_id", "t", "pos", "first", "last"])

    return docs.select("doc_id", "t", "text").mapInArrow(run, _START)


def stretches(docs: DataFrame) -> DataFrame:
    """Words (32-bit codes) and window hashes of the stretches listed with each document."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                w = _words(b)
                code, span = (w.hash >> np.uint64(32)).astype(np.uint32), _prefix(w)
                lists = b.column("stretches")
                flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
                first, last, h, s, n = (flat.field(k).to_numpy() for k in range(5))
                base = np.repeat(w.off[:-1], per)
                lo, hi = base + first, base + last + WINDOW
                words = [code[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                many = last - first + 1
                edges = np.concatenate([[0], np.cumsum(many)])
                at = np.repeat(lo - edges[:-1], many) + np.arange(edges[-1])
                wins = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(span(at, at + WINDOW).view(np.int64)))
                ids, texts = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), per) for c in ("doc_id", "t"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h, s, n, ids, texts, first)] + [pa.array(words, pa.binary()), wins],
                    names=["h", "s", "n", "doc_id", "t", "first", "words", "wins"])

    return docs.mapInArrow(run, _STRETCH)


def _automaton(givers) -> ahocorasick.Automaton:
    """Automaton over the word codes of passages, each with its first occurrence."""
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, place in givers:
        a.add_word(words, place)
    a.make_automaton()
    return a


def match(rows: pa.Table, patterns: int = PATTERNS) -> pa.Table:
    """Windows of whole shards' stretches that match a confirmed passage, and those with an earlier occurrence."""
    h, k, s, doc, t, first, at, own, n, stream = (rows[c].to_pylist() for c in (
        "h", "k", "s", "doc_id", "t", "first", "at", "own", "n", "stream"))
    raw = rows["words"].to_pylist()
    late, matched = [0] * len(h), [0] * len(h)

    def run(lo: int, hi: int, givers: list) -> None:
        a = _automaton(givers)
        for i in range(lo, hi):
            if stream[i]:
                for end, place in a.iter(tuple(np.frombuffer(raw[i], np.uint32).tolist())):
                    o = at[i] + end - WINDOW + 1
                    matched[i] |= 1 << o
                    if (doc[i], first[i] + o) > place:
                        late[i] |= 1 << o

    lo, givers = 0, []
    for i in range(len(h)):
        if i and (h[i], k[i]) != (h[i - 1], k[i - 1]) and len(givers) >= patterns // 2:
            run(lo, i, givers)
            lo, givers = i, []
        bits, words = own[i] >> at[i], np.frombuffer(raw[i], np.uint32).tolist() if own[i] else []
        for o in range(len(words) - WINDOW + 1):
            if bits >> o & 1:
                givers.append((tuple(words[o:o + WINDOW]), (doc[i], first[i] + at[i] + o)))
    for j in range(0, len(givers), patterns):      # more than one only if a single shard holds so many
        run(lo, len(h), givers[j:j + patterns])
    keep = [i for i in range(len(h)) if matched[i]]
    cols = [(x, pa.int64()) for x in (h, s, doc, t, first, n, late, matched)]
    return pa.table([pa.array([x[i] for i in keep], kind) for x, kind in cols],
                    names=[c.split()[0] for c in _MATCH.split(", ")])


def late_windows(docs: DataFrame, hot: int = HOT, patterns: int = PATTERNS) -> DataFrame:
    """``(doc_id, t, first, late)``: bit o of late says that the window at first + o has an earlier occurrence.

    ``docs`` has doc_id, text and t (a hash of text).
    """
    begun = materialise(starts(docs), "phrase-starts")
    shared = materialise(begun.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "phrase-grams")
    kept = materialise(begun.join(bounded(shared), "h").drop("pos"), "phrase-kept")
    discard(begun)
    first = kept.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first", "t")).alias("at"),
                                       F.min(F.col("last") - F.col("first")).alias("more"))
    listed = first.groupBy("at.doc_id", "at.t").agg(F.collect_list(F.struct(
        F.col("at.first").alias("first"), (F.col("at.first") + F.col("more")).alias("last"), "h", "s", "n")).alias("stretches"))
    listed = materialise(listed, "phrase-listed")
    some = bounded(materialise(listed.select("doc_id", "t"), "phrase-docs"))
    texts = docs.join(some, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    found = materialise(stretches(texts.join(listed, ["doc_id", "t"]).select("doc_id", "t", "text", "stretches")),
                        "phrase-stretches")
    wins = found.select("h", "s", "n", "doc_id", "first", F.posexplode("wins").alias("o", "w"))
    confirmed = materialise(wins.groupBy("h", "w").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"),
        F.min(F.struct("doc_id", (F.col("first") + F.col("o")).alias("start"), "s", "o")).alias("at")).where("n > 1"),
        "phrase-confirmed")
    own = confirmed.groupBy("h", F.col("at.s").alias("s")).agg(
        F.sum(F.expr("shiftleft(1L, at.o)")).alias("own"))
    given = found.join(own, ["h", "s"], "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    crowded = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("h"),
                          "phrase-hot")
    columns = ["h", "k", "s", "doc_id", "t", "first", "at", "own", "n", "stream", "words"]
    here = given.withColumn("k", F.lit(0).cast("long")).withColumn("at", F.lit(0)).withColumn("stream", F.lit(True))
    rows = here.join(bounded(crowded), "h", "left_anti").select(*columns)
    # A crowded gram is dealt by window; a crowded window in parts, its passage to each.
    parts = confirmed.select("h", "w", F.expr(f"cast(ceil(c / {hot}) as int)").alias("parts"))
    narrow = given.join(bounded(crowded), "h", "left_semi").select(
        "h", "s", "doc_id", "t", "first", "n", "words", "own", F.posexplode("wins").alias("at", "w")).join(
        parts, ["h", "w"]).withColumn("words", F.expr(f"substring(words, at * 4 + 1, {WINDOW * 4})")).withColumn(
        "own", F.expr("own & shiftleft(1L, at)"))
    part = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
    dealt = narrow.withColumn("mine", part).withColumn("part", F.explode(F.when(
        F.col("own") != 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))
    rows = rows.unionByName(dealt.withColumn("k", F.xxhash64("w", "part")).withColumn(
        "stream", F.col("part") == F.col("mine")).select(*columns))
    matches = materialise(map_groups(rows, ["h", "k"], lambda g: match(g, patterns), _MATCH, together=True), "phrase-matches")
    discard(found)
    mine = matches.where("late <> 0").select("doc_id", "t", "first", "late")
    # All other places of a stretch come later than its first.
    others = kept.join(matches.where("n > 1").select("h", "s", F.col("doc_id").alias("d0"), F.col("first").alias("f0"),
                                                     "matched"), ["h", "s"])
    others = others.where("doc_id <> d0 or first <> f0").select("doc_id", "t", "first", F.col("matched").alias("late"))
    return mine.unionByName(others)


def _cut(batches):
    """The words that stay: number, number removed and SHA-256 of the kept words."""
    for whole in batches:
        ids, total, removed, digests = [], [], [], []
        for doc, text, gone, lists in zip(*(whole.column(c).to_pylist() for c in ("doc_id", "text", "gone", "late")),
                                          strict=True):
            words = (text or "").encode().split()      # splits at exactly 0x20 and 0x09-0x0D
            n = len(words)
            kept = words
            if gone and n >= WINDOW:
                kept = []
            elif lists:
                cover = np.zeros(n + 1, np.int64)
                starts = np.array([x["first"] for x in lists])
                masks = np.array([x["late"] for x in lists])
                at = np.concatenate([starts[(masks >> o) & 1 == 1] + o for o in range(WINDOW - GRAM + 1)])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
            ids.append(doc)
            total.append(n)
            removed.append(n - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()),
                                          pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot: int = HOT, patterns: int = PATTERNS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumn("t", F.xxhash64("text"))
    digest = [F.xxhash64("text", F.lit(1)).alias("t2"), F.length("text").alias("size")]
    coded = keyed.where("doc_id is not null and text is not null").select("doc_id", "t", *digest)
    coded = materialise(coded, "phrase-digests")
    twice = materialise(coded.groupBy("t", "t2", "size").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("far")).where(
        "rep < far").drop("far"), "phrase-twice")
    copies = materialise(coded.join(bounded(twice), ["t", "t2", "size"]).where("doc_id > rep").select(
        "doc_id", "t").distinct(), "phrase-copies")
    copies = bounded(copies)
    single = keyed.where("doc_id is not null and text is not null").join(copies, ["doc_id", "t"], "left_anti")
    late = materialise(late_windows(single, hot, patterns).groupBy("doc_id", "t").agg(
        F.collect_list(F.struct("first", "late")).alias("late")), "phrase-late")
    ids = bounded(materialise(late.select("doc_id", "t"), "phrase-cut"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    none = F.lit(None).cast(late.schema["late"].dataType)
    touched = keyed.join(ids, ["doc_id", "t"], "left_semi").join(late, ["doc_id", "t"]).select(
        "doc_id", "text", F.lit(False).alias("gone"), "late")
    flags = copies.withColumn("gone", F.lit(True))
    rest = keyed.join(ids, ["doc_id", "t"], "left_anti").join(flags, ["doc_id", "t"], "left").select(
        "doc_id", "text", F.coalesce("gone", F.lit(False)).alias("gone"), none.alias("late"))
    return touched.mapInArrow(_cut, schema).unionByName(rest.mapInArrow(_cut, schema))


def op11_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


# Exact: all windows, their first occurrence, and the words under later ones.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT doc_id, p, md5(array_to_string(words[p + 1 : p + 20], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS p FROM w WHERE len(words) >= 20)),
late AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM g) WHERE r > 1),
i AS (SELECT doc_id, words[i] AS word, i - 1 AS i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
c AS (
  SELECT i.doc_id, i.word, i.i, max(CASE WHEN late.p IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY i.doc_id ORDER BY i.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM i LEFT JOIN late ON late.doc_id = i.doc_id AND late.p = i.i),
k AS (
  SELECT doc_id, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
