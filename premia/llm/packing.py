"""Operator 4: harmonic packing of documents into sequences of ``capacity`` tokens.

A document is tokenised (byte-level BPE, then the end id 1) and cut: whole
sequences first, then, while more than ``SMALL`` tokens are left, the largest
reciprocal part of the capacity (capacity // k) that they fill; the rest is one
piece. A piece of length n belongs to class capacity // n, and a bin of class k
takes exactly k pieces. So bins of k <= 15 lose under k tokens, and only the small
rests lose more.

Each task fills its own bins of every class and needs no other task: a bin is
emitted once it has its k pieces, so a task holds one bin per class. Pieces left
in unfinished bins (fewer than k per class and task) go on to a round with fewer
tasks, and so on to a single one; what that leaves, under k pieces a class whatever
the input, is packed first-fit by falling length.

Pieces lie in their sequence without gaps from offset 0. Sequences are padded to the
capacity by whoever writes them.

Cases: null text is empty; an empty text is the end id alone; repeated rows are
documents of their own, also under a null id; no documents give no pieces. Other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, materialise

CAPACITY = 2048
SMALL = 128
END_ID = 1
FAN_IN = 64               # tasks whose unfinished bins meet in one task of the next round
CACHE = 300_000           # word encodings that a worker keeps
_PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, part long, piece long, "
           "sequence_id long, offset long")
_SPACE = re.compile(r" (?:\s|\Z)")
_BREAK = re.compile(r" (?=\S)")
# The byte-level pre-tokenizer's pattern (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids as little-endian uint32 bytes, word by word with a cache.

    The tokenizer's own split never joins a space that a visible character follows
    to what is before it, so a text can be cut before every such space and its words
    encoded alone. Added tokens (such as an end-of-text mark) inside a text are cut out first
    and keep their ids, as the tokenizer has it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Tokens that take blanks or whole words only with them are left to the tokenizer itself.
        self.odd = any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values())
        self.added = {c: array("I", [i]).tobytes() for c, (i, _) in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cache: dict[str, bytes] = {}
        tokens = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(tokens.values()) + 1, bool)      # tokens that begin with a space
        self.opens[[i for t, i in tokens.items() if t[0] == "\u0120"]] = True

        self.by_rank = self._ranked(path, tokens)

    def _ranked(self, path: str, tokens: dict[str, int]):
        """The same encoding by token ranks, several times faster on new words.

        None unless it must give the same ids: byte-level BPE without a normaliser, every merge's
        result numbered in the order of the merges, after the single bytes.
        """
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not spec["normalizer"] and split.get("type") == "ByteLevel"
                 and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("ignore_merges")
                 and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if not plain or any(tokens.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken
        # Byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256, 257, ...
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        if self.by_rank:
            return array("I", self.by_rank.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Adds words, each taken with a space before it; those without inner spaces are encoded in one text."""
        plain = [w for w in words if w and " " not in w]
        if plain:
            raw = self._ids(" " + " ".join(plain))
            at = (np.flatnonzero(self.opens[np.frombuffer(raw, np.uint32)]) * 4).tolist()
            self.cache.update(zip(plain, (raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        self.cache.update((w, self._ids(" " + w)) for w in words if not w or " " in w)

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        if self.odd:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.marks.split(text)))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        words = _BREAK.split(text) if _SPACE.search(text) else text.split(" ")
        first = self._ids(words[0]) if words[0] else b""
        del words[0]
        new = list(set(words).difference(self.cache))
        if new:
            self._learn(new)
        out = first + b"".join(map(self.cache.__getitem__, words))
        if len(self.cache) > CACHE:
            for w in new:
                del self.cache[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > SMALL:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return [*out, n] if n else out


class Bins:
    """Open bins of a task, one per class; ``add`` returns a finished bin's pieces with their places."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, {}

    def add(self, length: int, piece) -> list[tuple]:
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, piece))
        if len(held) < k:
            return []
        del self.open[k]
        return self.place(held)

    def place(self, held: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for length, piece in held:
            out.append((piece, self.next, at))
            at += length
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [x for held in self.open.values() for x in held]

    def first_fit(self) -> list[tuple]:
        """The rest in as few bins as first-fit by falling length needs."""
        bins: list[list] = []
        for length, piece in sorted(self.rest(), key=lambda x: -x[0]):
            for b in bins:
                if b[0] + length <= self.capacity:
                    b[0] += length
                    b[1].append((length, piece))
                    break
            else:
                bins.append([length, [(length, piece)]])
        return [x for b in bins for x in self.place(b[1])]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema.split(","))
    types = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)],
                                      names=[n for n, _ in fields])


def cut_and_fill(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """All pieces; those of unfinished bins have no sequence yet."""
    def run(batches):
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        bins, count = Bins(capacity, part << 32), 0
        end = array("I", [END_ID]).tobytes()
        for whole in batches:
            for b in textops.pieces(whole):
                out = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    n, start = len(ids) // 4, 0
                    for length in cut(n, capacity):
                        row = (doc, start, length, ids[4 * start:4 * (start + length)], n, part, count)
                        out += [(*x, seq, at) for x, seq, at in bins.add(length, row)]
                        start += length
                        count += 1
                yield _table(out, _PIECES)
        yield _table([(*x, None, None) for _, x in bins.rest()], _PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


_PLACES = "part long, piece long, length long, sequence_id long, offset long"


def refill(rest: DataFrame, tasks: int, level: int, capacity: int) -> DataFrame:
    """One more round over unfinished bins' pieces; the round of a single task places them all."""
    def run(batches):
        bins = Bins(capacity, (level << 58) | (TaskContext.get().partitionId() << 32))
        for b in batches:
            out = []
            for part, piece, length in zip(*(b.column(c).to_pylist() for c in ("part", "piece", "length")), strict=True):
                out += [(*x, seq, at) for x, seq, at in bins.add(length, (part, piece, length))]
            yield _table(out, _PLACES)
        last = bins.first_fit() if tasks == 1 else [(x, None, None) for _, x in bins.rest()]
        yield _table([(*x, seq, at) for x, seq, at in last], _PLACES)

    return rest.coalesce(1).mapInArrow(run, _PLACES) if tasks == 1 else rest.repartition(tasks).mapInArrow(run, _PLACES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian uint32), ``doc_tokens, sequence_id, offset``."""
    pieces = materialise(cut_and_fill(docs, tokenizer, capacity), "packing-pieces")
    rest = pieces.where("sequence_id is null").select("part", "piece", "length")
    tasks, level, placed = max(1, docs.rdd.getNumPartitions() // FAN_IN), 1, None
    while True:
        done = materialise(refill(rest, tasks, level, capacity), "packing-places")
        full = done.where("sequence_id is not null").drop("length")
        placed = full if placed is None else placed.unionByName(full)
        if tasks == 1:
            break
        rest = done.where("sequence_id is null").select("part", "piece", "length")
        tasks, level = max(1, tasks // FAN_IN), level + 1
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    late = pieces.where("sequence_id is null").drop("sequence_id", "offset").join(bounded(placed), ["part", "piece"])
    return pieces.where("sequence_id is not null").select(*names).unionByName(late.select(*names))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces with ``ids_crc32`` for their ids."""
    p = pack(docs, tokenizer or tokenizer_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
